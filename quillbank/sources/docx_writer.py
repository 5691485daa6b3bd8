"""Word documents of questions, built in executors."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Namespaces, content types and relationship parts that the format prescribes.
_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: What each content mode shows: questions, answers, explanations.
MODES = {"paper_only": (True, False, False), "answers_only": (False, True, False), "paper_and_answers": (True, True, False), "paper_answers_explanations": (True, True, True)}
_LINES_HELD = 1024
_SHAPE = "document string, n_lines long, content_sha256 string, content binary"
_ARROW = pa.schema([("document", pa.string()), ("n_lines", pa.int64()), ("content_sha256", pa.string()), ("content", pa.binary())])


def document_lines(questions: DataFrame, document: str, order: list, section: str, mode: str = "paper_answers_explanations") -> DataFrame:
    """(document, position, line) of questions (`document`, *order, `section`, stem, options, answer, explanation, tag_names).

    A new section gets its heading; questions are numbered through a document. Answers stand after all questions of a
    document unless each is shown with its explanation. Order columns have to be total within a document.
    """
    from pyspark.sql import Window

    shown, answers, explained = MODES[mode]
    w = Window.partitionBy(document).orderBy(*order)
    n = F.row_number().over(w)
    starts = ~F.lag(section).over(w).eqNullSafe(F.col(section)) | (n == 1)
    q = questions.withColumn("__n", n).withColumn("__starts", starts)
    option = F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda x, i: F.concat(F.when(i < 26, F.char(i + 65)).otherwise((i + 1).cast("string")), F.lit(". "), F.coalesce(x, F.lit(""))))
    number = F.concat(F.col("__n").cast("string"), F.lit(". "))
    heading = F.when(F.col("__starts"), F.array(F.coalesce(F.col(section), F.lit("")))).otherwise(F.array().cast("array<string>"))
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    tags = F.array_join(F.coalesce("tag_names", F.array().cast("array<string>")), "、")
    asked = F.concat(heading, F.array(F.concat(number, text("stem"))), option, F.when(tags != "", F.array(F.concat(F.lit("标签："), tags))).otherwise(F.array().cast("array<string>")))
    alone = F.concat(number, text("answer")) if not explained else F.concat(F.lit("【答案】"), text("answer"))
    solved = F.array(alone, F.concat(F.lit("【解析】"), text("explanation"))) if explained else F.array(alone)
    parts = []
    if shown:
        body = F.concat(asked, solved) if explained else asked
        parts.append((0, body))
    if answers and not explained:
        first = F.when(F.col("__n") == 1, F.array(F.lit("参考答案"))).otherwise(F.array().cast("array<string>"))
        parts.append((1, F.concat(first, heading, solved)))
    out = None
    for rank, lines in parts:
        rows = q.select(F.col(document).cast("string").alias("document"), F.lit(rank).alias("__rank"), "__n", F.posexplode(lines).alias("__k", "line"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("document", F.struct("__rank", "__n", "__k").alias("position"), "line")


class _Package:
    """A document being written line by line; only what is compressed is held."""

    def __init__(self) -> None:
        self.buffer, self.n_lines, self.held = io.BytesIO(), 0, []
        self.archive = zipfile.ZipFile(self.buffer, "w")
        info = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        self.archive.writestr(info("[Content_Types].xml"), _TYPES)
        self.archive.writestr(info("_rels/.rels"), _LINKS)
        body = info("word/document.xml")
        body.compress_type = zipfile.ZIP_DEFLATED
        self.body = self.archive.open(body, "w")
        self.held.append(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_MAIN}"><w:body>')

    def add(self, line: str) -> None:
        broken = '</w:t><w:br/><w:t xml:space="preserve">'.join(escape("".join(c for c in part if c >= " " or c == "\t")) for part in line.split("\n"))
        self.held.append(f'<w:p><w:r><w:t xml:space="preserve">{broken}</w:t></w:r></w:p>')
        self.n_lines += 1
        if len(self.held) >= _LINES_HELD:
            self.flush()

    def flush(self) -> None:
        self.body.write("".join(self.held).encode())
        self.held.clear()

    def done(self) -> bytes:
        self.held.append("</w:body></w:document>")
        self.flush()
        self.body.close()
        self.archive.close()
        return self.buffer.getvalue()


def documents(lines: DataFrame) -> DataFrame:
    """(document, n_lines, content_sha256, content) of lines (document, position, line); a task holds one at a time.

    Equal lines give equal bytes. A document is one file, so it has to fit a task; lines are compressed as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(name, made: _Package) -> pa.RecordBatch:
            data = made.done()
            return pa.RecordBatch.from_pylist([{"document": name, "n_lines": made.n_lines, "content_sha256": hashlib.sha256(data).hexdigest(), "content": data}], schema=_ARROW)

        at, made = None, None
        for batch in batches:
            for name, line in zip(batch.column("document").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if made is None or name != at:
                    if made is not None:
                        yield done(at, made)
                    at, made = name, _Package()
                made.add(line or "")
        if made is not None:
            yield done(at, made)

    dealt = lines.repartition("document").sortWithinPartitions("document", "position")
    return dealt.select("document", "line").mapInArrow(run, _SHAPE)
