"""The whole bank as ordered export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbank.functions.tables import numbered
from quillbank.functions.text import cell_text, option_lines, utc_text
from quillbank.sources import docx_writer, xlsx_writer
from quillbank.sources.committed_files import save_files

#: Fixed value: what ends a text that a cell cannot hold whole.
CUT = "…（内容已截断）"
#: Export columns in order, with their headings.
HEADINGS = {
    "row_number": "序号",
    "type_name": "题型",
    "subject_name": "学科",
    "chapter_name": "章节",
    "stem": "题干",
    "options": "选项",
    "answer": "答案",
    "explanation": "解析",
    "tags": "标签",
    "last_used": "最近使用",
    "created": "创建时间",
    "updated": "更新时间",
    "question_id": "题目ID",
    "unit_name": "单元",
}


def export_rows(questions: DataFrame, order: list[Column]) -> DataFrame:
    """One row of text cells for each question, numbered from 1 in `order`, which has to be total.

    questions (question_id, question_type, type_name, subject_name, chapter_name, unit_name, stem, options, answer,
    explanation, tag_names, last_used_at_ms, created_at_ms, updated_at_ms). A type without a name shows its code; other
    nulls are blank cells; texts are trimmed, and cut where a cell cannot hold them. Numbers do not need one task.
    """
    plain = lambda c: F.coalesce(F.trim(c), F.lit(""))
    cells = {
        "type_name": F.coalesce("type_name", "question_type"),
        "stem": plain("stem"),
        "options": option_lines(F.transform("options", lambda x: F.coalesce(x, F.lit("")))),
        "answer": plain("answer"),
        "explanation": plain("explanation"),
        "tags": F.array_join("tag_names", "、"),
        "last_used": utc_text(F.col("last_used_at_ms")),
        "created": utc_text(F.col("created_at_ms")),
        "updated": utc_text(F.col("updated_at_ms")),
    }
    rows = numbered(questions, order, "__row")
    texts = [F.coalesce(cell_text(cells.get(c, F.col(c)), suffix=CUT), F.lit("")).alias(c) for c in HEADINGS if c != "row_number"]
    return rows.select((F.col("__row") + 1).alias("row_number"), *texts)


#: Fixed value: the order of a whole bank, over rows of with_sort_keys().
EXPORT_ORDER = ("subject_sort", "subject_id", "chapter_sort", "chapter_id", "type_sort", "question_type", "created_at_ms", "question_id")


def with_sort_keys(questions: DataFrame, subjects: DataFrame, chapters: DataFrame, types: DataFrame) -> DataFrame:
    """questions (question_id, subject_id, chapter_id, question_type, created_at_ms, ...) with the columns of EXPORT_ORDER.

    subjects (subject_id, sort_order), chapters (chapter_id, sort_order), types (code, sort_order). Questions whose
    subject, chapter or type is not there are left out, as they have no place; a null sort order comes first.
    """
    placed = lambda df, key, to: df.select(F.col(key), F.col("sort_order").alias(f"{to}_sort"))
    out = questions.join(placed(subjects, "subject_id", "subject"), "subject_id").join(placed(chapters, "chapter_id", "chapter"), "chapter_id")
    return out.join(placed(types, "code", "type").withColumnRenamed("code", "question_type"), "question_type")


MESSAGE_LIMIT = 2000


def export_runs(started: DataFrame, finished: DataFrame) -> DataFrame:
    """The state of each export in started (run_id, ...) after finished (run_id, finished_at_ms, error_code, error_message, output_byte_size).

    A run is running until its first end in time (of several at once: without an error, then by code, message and size)
    and keeps that state; `refused` counts the later ends. An end with an error code has failed and has no size; its
    message is cut at 2,000 characters. Ends of unknown runs are left out.
    """
    end = F.struct("finished_at_ms", "error_code", F.left("error_message", F.lit(MESSAGE_LIMIT)).alias("error_message"), "output_byte_size")
    ends = finished.groupBy("run_id").agg(F.min(end).alias("__end"), F.count("*").alias("__ends"))
    both = started.join(ends, "run_id", "left")
    status = F.when(F.col("__end").isNull(), "running").when(F.col("__end.error_code").isNotNull(), "failed").otherwise("succeeded")
    size = F.when(status == "succeeded", F.col("__end.output_byte_size"))
    known = {c: F.col(f"__end.{c}") for c in ("finished_at_ms", "error_code", "error_message")}
    refused = F.greatest(F.coalesce("__ends", F.lit(0)) - 1, F.lit(0))
    return both.withColumns({"status": status, **known, "output_byte_size": size, "refused": refused}).drop("__end", "__ends")


ROWS_EACH = 20_000
_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _joined(rows: DataFrame, line: Column, rows_each: int, first: str | None = None) -> DataFrame:
    """(book, content): the lines of at most rows_each rows, in order of row_number, each with its end."""
    book = F.floor((F.col("row_number") - 1) / rows_each).alias("book")
    lines = rows.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("row_number", line.alias("line")))).alias("x"))
    whole = F.transform("x", lambda x: F.concat(x["line"], F.lit("\n")))
    return lines.select("book", F.array_join(F.concat(F.array(F.lit(first)), whole) if first else whole, "").alias("content"))


def document_rows(rows: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """(document, position, line) of export rows, a document for at most rows_each of them.

    A heading stands where subject or chapter is another than in the row before; blank parts have no line.
    """
    book = F.floor((F.col("row_number") - 1) / rows_each)
    w = Window.partitionBy(book).orderBy("row_number")
    place = F.struct("subject_name", "chapter_name")
    starts = ~F.lag(place).over(w).eqNullSafe(place)
    heading = F.when(F.col("__starts"), F.concat_ws(" / ", *(F.when(F.col(c) != "", F.col(c)) for c in ("subject_name", "chapter_name"))))
    named = lambda mark, c: F.when(F.col(c) != "", F.concat(F.lit(mark), F.col(c)))
    first = F.concat(F.col("row_number").cast("string"), F.lit(". "), F.col("stem"))
    options = F.when(F.col("options") != "", F.split("options", "\n")).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(heading, first), options, F.array(named("标签：", "tags"), named("【答案】", "answer"), named("【解析】", "explanation")))
    out = rows.withColumn("__starts", starts).select(book.cast("string").alias("document"), "row_number", F.posexplode(lines).alias("__k", "line"))
    return out.where("line is not null").select("document", F.struct("row_number", "__k").alias("position"), "line")


def bank_files(rows: DataFrame, kind: str, rows_each: int = ROWS_EACH) -> DataFrame:
    """(name, content): export rows as csv, json, xlsx or docx files of at most rows_each rows, which a task holds at once.

    Files are in order of row_number; csv, xlsx and docx have headings.
    """
    if kind == "csv":
        cells = F.struct(*(F.col(c).alias(h) for c, h in HEADINGS.items()))
        books = _joined(rows, F.to_csv(cells, _CSV), rows_each, ",".join(HEADINGS.values()) + "\n")
    elif kind == "json":
        books = _joined(rows, F.to_json(F.struct(*HEADINGS)), rows_each)
    elif kind == "xlsx":
        books = xlsx_writer.workbooks(rows, HEADINGS, rows_each=rows_each)
    elif kind == "docx":
        books = docx_writer.documents(document_rows(rows, rows_each)).withColumnRenamed("document", "book")
    else:
        raise ValueError("csv, json, xlsx, docx or parquet")
    return books.select(F.format_string(f"bank-%05d.{kind}", F.col("book").cast("long")).alias("name"), F.col("content").cast("binary").alias("content"))


def save_bank(rows: DataFrame, kind: str, folder: str, rows_each: int = ROWS_EACH) -> None:
    """Writes export rows to a new folder as csv, json, xlsx, docx or parquet, all files or none.

    Files hold at most rows_each rows each and are put in place by one commit, with a manifest; no file passes the
    driver. An existing folder is refused, and so is an export without rows. Parquet is Spark's own writer.
    """
    if kind == "parquet":
        rows.repartitionByRange("row_number").sortWithinPartitions("row_number").write.parquet(folder)
    else:
        save_files(bank_files(rows, kind, rows_each), folder)


def saved_bank(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    """What save_bank() has written as csv, json or parquet, under the names of the columns; csv does not tell blank cells from nulls, so they are blank.

    Workbooks and documents are read by their own sources.
    """
    if kind != "csv":
        found = spark.read.schema(", ".join(f"{c} {'bigint' if c == 'row_number' else 'string'}" for c in HEADINGS)).format(kind)
        return found.option("pathGlobFilter", f"*-*.{kind}").load(folder)
    found = spark.read.csv(folder, header=True, escape='"', multiLine=True, pathGlobFilter="*.csv")
    return found.select(*(F.col(h).cast("long").alias(c) if c == "row_number" else F.coalesce(F.col(h), F.lit("")).alias(c) for c, h in HEADINGS.items()))
