"""Export rows and workbooks, read back by the reader."""

import pytest
from pyspark.sql import functions as F

from quillbank.operators.exports import CUT, HEADINGS, export_rows
from quillbank.sources.xlsx import read_workbooks
from quillbank.sources.xlsx_writer import column_label, save_workbooks, workbooks

SHAPE = "question_id string, question_type string, type_name string, subject_name string, chapter_name string, unit_name string, stem string, options array<string>, answer string, explanation string, tag_names array<string>, last_used_at_ms long, created_at_ms long, updated_at_ms long"


def bank(spark):
    rows = [(f"q{i}", "short_answer", None if i == 1 else "简答题", "Maths", "One", None, f" s{i} <&>\x01 ", [" x ", "y"] if i == 2 else [], "a", None, ["t", "u"], None, 1000 * i, 0) for i in range(1, 6)]
    rows.append(("q9", "short_answer", "简答题", "Maths", "One", "U", "长" * 40000, None, None, None, None, 0, 9000, 0))
    return spark.createDataFrame(rows, SHAPE)


def test_rows(spark):
    got = export_rows(bank(spark), [F.col("created_at_ms"), F.col("question_id")]).orderBy("row_number").collect()
    assert got[0].asDict().keys() == HEADINGS.keys()
    assert [r["row_number"] for r in got] == [1, 2, 3, 4, 5, 6]
    assert (got[0]["type_name"], got[0]["stem"], got[0]["tags"], got[0]["last_used"], got[0]["created"]) == ("short_answer", "s1 <&>", "t、u", "", "1970-01-01 00:00:01 UTC")
    assert got[1]["options"] == "A. x\nB. y"
    assert len(got[5]["stem"]) == 32767 and got[5]["stem"].endswith(CUT) and got[5]["options"] == "" and got[5]["unit_name"] == "U"


def test_books_round_trip(spark, tmp_path):
    books = workbooks(export_rows(bank(spark), [F.col("created_at_ms"), F.col("question_id")]), HEADINGS, rows_each=4)
    assert [(r["book"], r["n_rows"]) for r in books.orderBy("book").collect()] == [(0, 4), (1, 2)]
    assert books.orderBy("book").select("content_sha256").collect() == books.orderBy("book").select("content_sha256").collect()
    folder = str(tmp_path / "out")
    assert len(save_workbooks(books, folder)) == 2
    with pytest.raises(FileExistsError):
        save_workbooks(books, folder)
    got = read_workbooks(spark, folder).orderBy("path", "row_number").collect()
    assert [r["error"] for r in got] == [None] * 6
    assert [r["stem"] for r in got[:5]] == [f"s{i} <&>" for i in range(1, 6)]
    assert got[1]["options"] == ["x", "y"] and got[0]["tag_names"] == ["t", "u"]
    assert workbooks(export_rows(bank(spark).where("false"), [F.col("question_id")]), HEADINGS).count() == 0


def test_labels():
    assert [column_label(i) for i in (1, 26, 27, 52, 702, 703)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]
