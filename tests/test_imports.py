"""Workbooks and imported rows."""

import zipfile

from quillbank.operators.imports import resolved
from quillbank.sources.xlsx import combined_options, read_workbooks, split_tags

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, rows, name="题库"):
    body = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t xml:space="preserve">{x}</t></is></c>' for j, x in enumerate(r) if x is not None) + "</row>"
        for i, r in enumerate(rows, 1)
        if r
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINK}"><sheets><sheet name="other" sheetId="1" r:id="r2"/><sheet name="{name}" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/none.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


def test_workbook_rows(spark, tmp_path):
    rows = [["a title"], [], ["题 型", "题干", "Answer", "选项B", "选项A", "Tags", "options"], ["单选", "s1", "a", "two", "one", "x、X,y", "A. no"], [None, "", ""], ["简答", "s2", "（未填写）。", "", "", "", "a) p\nq\nB. r"]]
    workbook(tmp_path / "a.xlsx", rows)
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    workbook(tmp_path / "c.xlsx", [["stem", "answer"]])
    got = sorted(read_workbooks(spark, str(tmp_path)).collect(), key=lambda r: (r["path"], r["row_number"] or 0))
    assert [(r["row_number"], r["question_type"], r["stem"], r["options"], r["answer"], r["tag_names"], r["unit_name"]) for r in got[:2]] == [(4, "单选", "s1", ["one", "two"], "a", ["x", "y"], None), (6, "简答", "s2", ["p\nq", "r"], "", [], None)]
    assert [r["error"] is None for r in got] == [True, True, False, False]


def test_cell_parsers():
    assert combined_options("A. x\nmore\nb、y\nA) z") == ["z", "y"] and combined_options("no letters here") == []
    assert split_tags(" a；A\nb ") == ["a", "b"]


def test_names_become_ids(spark):
    subjects = spark.createDataFrame([("s1", "Maths"), ("s2", "Art")], "subject_id string, name string")
    chapters = spark.createDataFrame([("c1", "s1", "One"), ("c2", "s2", "One")], "chapter_id string, subject_id string, name string")
    units = spark.createDataFrame([("u1", "c1", "U")], "unit_id string, chapter_id string, name string")
    types = spark.createDataFrame([("single_choice", "单选题", "single_choice", []), ("true_false", "判断题", "single_choice", ["正确", "错误"]), ("short_answer", "简答题", "open_response", [])], "code string, name string, behavior string, default_options array<string>")
    shape = "k int, question_type string, subject_name string, chapter_name string, unit_name string, options array<string>, answer string"
    rows = [(1, "单选题", "ＭＡＴＨＳ", "one", "u", [" x ", ""], "b, A"), (2, "判断题", "", "", None, [], "对"), (3, "怪题", "art", "", "", ["x"], " t "), (4, "多选怪题", "nobody", "One", None, ["x"], "AB")]
    got = {r["k"]: r for r in resolved(spark.createDataFrame(rows, shape), subjects, chapters, units, types, "s1", "c1", "u1").collect()}
    pick = lambda k: tuple(got[k][c] for c in ("code", "subject_id", "chapter_id", "unit_id", "options", "answer", "unknown_type"))
    assert pick(1) == ("single_choice", "s1", "c1", "u1", ["x"], "B、A", None)
    assert pick(2) == ("true_false", "s1", "c1", "u1", ["正确", "错误"], "正确", None)
    assert pick(3) == ("short_answer", "s2", None, None, [], "t", "怪题")
    assert pick(4) == ("short_answer", None, None, None, ["x"], "A、B", "多选怪题")
