"""Word documents, formulas, archives and resources."""

import hashlib
import io
import tracemalloc
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quillbank.functions.omml import latex
from quillbank.operators import resources as S
from quillbank.operators.recognition import lines_of_paragraphs, lines_with_formulas, recognised_questions
from quillbank.sources import archive, docx, docx_writer

SPACES = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
)


def math(inner):
    return latex(ElementTree.fromstring(f"<m:oMath {SPACES}>{inner}</m:oMath>"))


def r(t):
    return f"<m:r><m:t>{t}</m:t></m:r>"


def e(t, name="e"):
    return f"<m:{name}>{r(t)}</m:{name}>"


@pytest.mark.parametrize(
    ("markup", "expected"),
    [
        (f"<m:f>{e('1', 'num')}{e('x', 'den')}</m:f>", r"\frac{1}{x}"),
        (f"<m:sSup>{e('x')}{e('2', 'sup')}</m:sSup>", "x^{2}"),
        (f"<m:sSubSup>{e('xy')}{e('1', 'sub')}{e('2', 'sup')}</m:sSubSup>", "{xy}_{1}^{2}"),
        (f"<m:f><m:fPr><m:type m:val='noBar'/></m:fPr>{e('5', 'num')}{e('2', 'den')}</m:f>", r"\genfrac{}{}{0pt}{}{5}{2}"),
        (f"<m:f><m:fPr><m:type m:val='skw'/></m:fPr>{e('5', 'num')}{e('2', 'den')}</m:f>", "{5}/{2}"),
        (f"<m:rad><m:radPr><m:degHide m:val='1'/></m:radPr><m:deg/>{e('x')}</m:rad>", r"\sqrt{x}"),
        (f"<m:rad>{e('3', 'deg')}{e('x')}</m:rad>", r"\sqrt[3]{x}"),
        (f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr>{e('i', 'sub')}{e('n', 'sup')}{e('i')}</m:nary>", r"\sum_{i}^{n} i"),
        (f"<m:d>{e('x')}</m:d>", r"\left( x\right)"),
        (f"<m:func>{e('sin', 'fName')}{e('α')}</m:func>", r"\sin \alpha"),
        (f"<m:m><m:mr>{e('a')}{e('b')}</m:mr><m:mr>{e('c')}{e('d')}</m:mr></m:m>", r"\begin{matrix}a & b \\ c & d\end{matrix}"),
        ("", ""),
    ],
)
def test_formulas(markup, expected):
    assert math(markup) == (expected, True)


def test_unknown_formula_parts():
    assert math("<m:odd/>" + r("x")) == ("x", False)
    assert math(f"<m:f><m:fPr><m:type m:val='odd'/></m:fPr>{e('5', 'num')}{e('2', 'den')}</m:f>{r('y')}") == ("y", False)


def package(path, inner, media=b"pixels"):
    links = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/a.png"/><Relationship Id="r2" Target="http://x" TargetMode="External"/></Relationships>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACES}><w:body>{inner}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", links)
        z.writestr("word/media/a.png", media)


def p(inner):
    return f"<w:p>{inner}</w:p>"


def t(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def test_documents(spark, tmp_path):
    picture = '<w:r><w:drawing><wp:inline><wp:extent cx="95250" cy="19050"/><a:blip r:embed="r1"/></wp:inline></w:drawing></w:r>'
    box = f"<w:r><w:pict><w:txbxContent>{p(t('hidden'))}</w:txbxContent></w:pict></w:r>"
    table = f"<w:tbl><w:tr><w:tc>{p(t('c1'))}</w:tc><w:tc><w:tbl><w:tr><w:tc>{p(t('inner'))}</w:tc></w:tr></w:tbl>{p('')}</w:tc></w:tr></w:tbl>"
    first = p(t("1. 求 ") + "<m:oMath>" + r("x") + "</m:oMath>" + t("2", '<w:vertAlign w:val="superscript"/>') + "<w:del>" + t("gone") + "</w:del>" + box + picture)
    package(tmp_path / "a.docx", first + p(t("   ", '<w:u w:val="single"/>')) + table + p(t("答案：x")))
    package(tmp_path / "b.docx", "<w:altChunk/>")
    (tmp_path / "c.docx").write_bytes(b"no")
    found = docx.read_documents(spark, str(tmp_path))
    rows = {x["path"][-6:]: x for x in found.collect()}
    assert [rows[k]["error"] is None for k in ("a.docx", "b.docx", "c.docx")] == [True, False, False]
    a = rows["a.docx"]
    assert [x["text"] for x in a["paragraphs"]] == ["1. 求 \ufffc2", "___", "c1", "inner", "", "答案：x"]
    assert [(x["table_id"], x["table_row"], x["table_cell"]) for x in a["paragraphs"]][2:4] == [(0, 0, 0), (0, 0, 1)] and a["paragraphs"][5]["table_id"] is None
    assert (a["images"][0]["at"], a["images"][0]["sha256"], a["images"][0]["width_px"], a["images"][0]["mime_type"]) == (7, hashlib.sha256(b"pixels").hexdigest(), 10, "image/png")
    assert [tuple(x) for x in a["formulas"]] == [(0, 5, "f0", "x", True)] and [tuple(x) for x in a["paragraphs"][0]["scripts"]] == [(6, 7, "sup")]
    lines = lines_with_formulas(*(docx.document_parts(found, x) for x in ("paragraphs", "images", "formulas")))
    got = recognised_questions(lines).collect()
    assert len(got) == 1 and got[0]["stem"] == "求 \ue000f0\ue0012\n___\n" and got[0]["answer"] == "x" and got[0]["attachments"] == ["r1", "table:0"]
    shown = lambda df: sorted((x["doc_id"], x["paragraph_index"], x["text"], [tuple(a) for a in x["attachments"]]) for x in df.collect())
    assert shown(lines_of_paragraphs(docx.paragraphs_with_parts(spark.read.format("binaryFile").load(f"{tmp_path}/*.docx")))) == shown(lines)


def test_long_documents_are_written_and_read_piece_by_piece():
    """Neither the markup nor the tree of a long document is held whole."""
    tracemalloc.start()
    made = docx_writer._Package()
    for i in range(60_000):
        made.add(f"{i}. line of a document")
    data = made.done()
    written = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    found = docx._paragraph_batches("d", data)
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        size = z.getinfo("word/document.xml").file_size
    assert [x for b in found for x in b.column("text").to_pylist()] == [f"{i}. line of a document" for i in range(60_000)]
    assert [x for b in found for x in b.column("paragraph_index").to_pylist()] == list(range(60_000))
    assert written < size and read < 4 * size, (written, read, size)
    broken = docx_writer._Package()
    for i in range(10_000):
        broken.add("x")
    broken.held.append("<w:p>")
    assert docx._paragraph_batches("d", broken.done()) == []


def test_documents_round_trip(spark, tmp_path):
    shape = "paper string, k int, kind string, stem string, options array<string>, answer string, explanation string, tag_names array<string>"
    rows = [("p", 1, "一、选择题", "甲 <&>\nx", ["a", "b"], "A", "e1", ["t"]), ("p", 2, "一、选择题", "乙", ["c", "d"], "B", None, None), ("p", 3, "二、简答题", "丙", None, "z", "", [])]
    questions = spark.createDataFrame(rows, shape)
    lines = docx_writer.document_lines(questions, "paper", [F.col("k")], "kind")
    made = docx_writer.documents(lines).collect()
    assert len(made) == 1 and made[0]["content_sha256"] == hashlib.sha256(bytes(made[0]["content"])).hexdigest()
    (tmp_path / "p.docx").write_bytes(bytes(made[0]["content"]))
    back = docx.document_parts(docx.read_documents(spark, str(tmp_path)), "paragraphs")
    texts = [x["text"] for x in back.orderBy("paragraph_index").collect()]
    assert texts[:6] == ["一、选择题", "1. 甲 <&>\nx", "A. a", "B. b", "标签：t", "【答案】A"] and len(texts) == made[0]["n_lines"] == 16
    got = recognised_questions(back.select("doc_id", "paragraph_index", "text")).orderBy("ordinal").collect()
    assert [(x["code"], x["answer"]) for x in got] == [("single_choice", "A"), ("single_choice", "B"), ("short_answer", "z")]
    paper = lambda mode: [x["line"] for x in docx_writer.document_lines(questions, "paper", [F.col("k")], "kind", mode).orderBy("position").collect()]
    assert paper("answers_only") == ["参考答案", "一、选择题", "1. A", "2. B", "二、简答题", "3. z"]
    assert paper("paper_and_answers")[-6:] == paper("answers_only") and len(paper("paper_only")) == 10
    assert docx_writer.documents(lines.limit(0)).collect() == []


def test_archives(spark, tmp_path):
    tables = {"q": spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, t string"), "e": spark.createDataFrame([], "x long")}
    folder = f"file://{tmp_path}/backup"
    made = archive.create(spark, tables, folder, 5)
    assert made["tables"]["q"]["rows"] == 3 and archive.inspect(spark, folder) == made
    assert sorted(map(str, archive.restore(spark, folder)["q"].collect())) == sorted(map(str, tables["q"].collect()))
    with pytest.raises(FileExistsError):
        archive.create(spark, tables, folder, 5)
    tables["q"].limit(2).write.mode("overwrite").parquet(f"{folder}/q")
    with pytest.raises(archive.ArchiveError):
        archive.restore(spark, folder)
    with pytest.raises(archive.ArchiveError):
        archive.inspect(spark, f"{folder}/q")
    assert [x.name for x in tmp_path.iterdir()] == ["backup"]


def test_resources(spark):
    incoming = spark.createDataFrame([(b"a", "image/png"), (b"a", None), (b"b", "x"), (None, "x"), (b"c", "x")], "content binary, mime_type string")
    known = spark.createDataFrame([(hashlib.sha256(b"c").hexdigest(),)], "sha256 string")
    got = {bytes(x["content"]): x for x in S.stored(incoming, known).collect()}
    assert sorted(got) == [b"a", b"b"] and got[b"a"]["path"] == f"images/{hashlib.sha256(b'a').hexdigest()[:2]}/{hashlib.sha256(b'a').hexdigest()}"
    one, two = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert {tuple(x) for x in S.reference_changes(one, two, ["k"]).collect()} == {(3, "add"), (1, "remove")}
    refs = spark.createDataFrame([("a",), ("b",), ("m",)], "resource_id string")
    res = spark.createDataFrame([("a", "ready"), ("b", "lost"), ("u", "ready")], "id string, availability_status string")
    assert {tuple(x) for x in S.inconsistencies(refs, res).collect()} == {("b", "not ready"), ("m", "missing"), ("u", "unreferenced")}
    settings = spark.createDataFrame([("x", 7), ("y", 7), ("z", 0)], "scope string, interval_days int")
    records = spark.createDataFrame([("x", "automatic", "completed", 0), ("x", "manual", "completed", 9), ("z", "automatic", "completed", 0)], "scope string, backup_kind string, status string, completed_at_ms long")
    got = {x["scope"]: (x["next_due_ms"], x["due"]) for x in S.backups_due(settings, records, S.DAY_MS).collect()}
    assert got == {"x": (7 * S.DAY_MS, False), "y": (S.DAY_MS, True), "z": (S.DAY_MS, True)}
    logs = S.audit_rows(spark.createDataFrame([(1, "s")], "entity_id int, summary string"), "edit", "question", 3)
    assert logs.first() == logs.first() and logs.first()["entity_id"] == "1"
