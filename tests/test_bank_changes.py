"""Changes to the bank on small literal rows: empty tables, ties, rows that are not there."""

from quillbank.operators import bank, dedup

QUESTION = "id string, tags array<string>, chapter_id string, last_used_at_ms long, content_version long, updated_at_ms long, deleted_at_ms long"
EDIT = "id string, expected_version long, tags array<string>, chapter_id string"


def test_page_faults(spark):
    found = lambda rows: {r[0] for r in bank.page_faults(spark.createDataFrame(rows, "page int, total long, id string")).collect()}
    assert found([(1, 2, "a"), (2, 2, "b")]) == set() == found([])
    assert found([(1, 2, "a"), (2, 3, "a")]) == {"total changed", "repeated id", "missing rows"}


def test_copied_paper(spark):
    papers = spark.createDataFrame([("p", "T", "saved", 4, 1, 2, 3), ("q", "U", "draft", 1, 1, 1, None)], "id string, title string, paper_status string, row_version long, created_at_ms long, updated_at_ms long, saved_at_ms long")
    items = spark.createDataFrame([("i", "p", 0), ("j", "p", 1), ("k", "q", 0)], "id string, paper_id string, position int")
    paper, copied = bank.copied_paper(papers, items, "p", "n", 9)
    assert [tuple(r) for r in paper.collect()] == [("n", "T", "draft", 1, 9, 9, None)]
    rows = sorted((r["position"], r["paper_id"]) for r in copied.collect())
    assert rows == [(0, "n"), (1, "n")] and {r["id"] for r in copied.collect()}.isdisjoint({"i", "j", "k"})
    assert bank.copied_paper(papers, items, "none", "n", 9)[1].count() == 0


def test_batch_edit_and_undo_keep_null_tags(spark):
    before = spark.createDataFrame([("a", None, "c", 5, 1, 1, None), ("b", ["x"], None, None, 2, 1, None), ("z", ["x"], "c", 1, 1, 1, 7)], QUESTION)
    edits = spark.createDataFrame([("a", 1, ["t"], None), ("b", 1, ["t"], "d"), ("z", 1, None, None), ("no", 1, None, None)], EDIT)
    assert {tuple(r) for r in bank.edit_conflicts(before, edits).select("id", "reason").collect()} == {("b", "another version"), ("z", "in the bin"), ("no", "missing")}
    only = edits.where("id = 'a'")
    after = bank.batch_edited(before, only, "append", 9, reset_usage=True)
    assert tuple(after.where("id = 'a'").first()) == ("a", ["t"], "c", None, 2, 9, None)
    back = bank.undone(after, bank.undo_rows(before, only, "b1"), 11)
    assert tuple(back.where("id = 'a'").first()) == ("a", None, "c", 5, 3, 11, None)
    assert back.where("id <> 'a'").exceptAll(before.where("id <> 'a'")).count() == 0


def test_groups_of_any_size_merge_where_no_limit_is_set(spark):
    q = spark.range(1203).selectExpr("id", "array('t', concat('u', id % 3)) tags", "1L content_version", "cast(null as long) deleted_at_ms")
    asked = q.where("id < 1201").selectExpr("if(id < 700, 'large', 'small') group_id", "id", "1L expected_version").where("id < 700 or id >= 1000")
    binned = lambda df: df.where("deleted_at_ms = 9").count()
    assert binned(dedup.merge_checked(q, asked, 9)) == 200
    merged = dedup.merge_checked(q, asked, 9, most_members=None)
    assert binned(merged) == 899 and merged.where("id = 0").first()["tags"] == ["t", "u0", "u1", "u2"]


def test_merges_of_any_size_are_undone(spark):
    q = spark.range(700).selectExpr("id", "array('t', concat('u', id % 3)) tags", "1L content_version", "cast(null as long) deleted_at_ms")
    asked = q.selectExpr("'large' group_id", "id", "1L expected_version")
    back = dedup.merge_undone(dedup.merge_checked(q, asked, 9, most_members=None), dedup.merge_undo_rows(q, asked, None))
    assert back.where("content_version = 3 and deleted_at_ms is null and size(tags) = 2").count() == 700
