"""Deletes with consequences, overwrites, restores, merges, JSON edits and names in order, on small cases."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillbank.functions import json_edit
from quillbank.functions.text import period_start
from quillbank.operators import bank, dedup, deletes, history, overwrites, stats
from quillbank.operators.deletes import Link

KEYS = {x: ("id",) for x in "abcd"}
LINKS = [Link("b", ("a_id",), "a", ("id",), "cascade"), Link("c", ("b_id",), "b", ("id",), "cascade"), Link("c", ("a_id",), "a", ("id",), "restrict"), Link("d", ("b_id",), "b", ("id",), "set null"), Link("d", ("c_id",), "c", ("id",), "restrict")]


def _tables(spark):
    rows = {
        "a": ([(1,), (2,), (3,), (4,), (None,)], "id int"),
        "b": ([(10, 1), (11, 1), (20, 2), (30, 3), (99, None)], "id int, a_id int"),
        "c": ([(100, 10, 1), (101, 11, None), (200, 20, 3), (300, 30, 4)], "id int, b_id int, a_id int"),
        "d": ([(1000, 11, None), (1001, 20, 200), (1002, 99, None), (1003, 30, None)], "id int, b_id int, c_id int"),
    }
    return {t: spark.createDataFrame(*x) for t, x in rows.items()}


def test_deletes_cascade_restrict_and_set_null(spark):
    ids = spark.createDataFrame([(1,), (1,), (2,), (4,), (7,), (None,)], "id int")
    changed, refused = deletes.deleted(_tables(spark), KEYS, LINKS, "a", ids)
    # 1 goes with 10, 11, 100 and 101, as what restricts it goes along; 2 would take 200, which 1001 needs; 300 needs 4.
    assert {tuple(r) for r in refused.collect()} == {(2, "d", 1), (4, "c", 1), (7, "missing", 0), (None, "missing", 0)}
    got = {t: sorted((tuple(r) for r in df.collect()), key=str) for t, df in changed.items()}
    assert got["a"] == [(2,), (3,), (4,), (None,)] and got["b"] == [(20, 2), (30, 3), (99, None)] and got["c"] == [(200, 20, 3), (300, 30, 4)]
    assert got["d"] == [(1000, None, None), (1001, 20, 200), (1002, 99, None), (1003, 30, None)]
    same, none = deletes.deleted(_tables(spark), KEYS, LINKS, "a", ids.limit(0))
    assert none.count() == 0 and {t: df.count() for t, df in same.items()} == {"a": 5, "b": 5, "c": 4, "d": 4}


def test_plans_of_deletes():
    assert deletes.cascade_order("a", LINKS) == ["a", "b", "c"] and deletes.cascade_order("d", LINKS) == ["d"]
    with pytest.raises(ValueError, match="circle"):
        deletes.cascade_order("a", [*LINKS, Link("a", ("x",), "c", ("id",), "cascade")])
    with pytest.raises(ValueError):
        Link("a", ("x",), "b", ("id",), "ignore")


TEXTS = [
    '{"b":1.5,"a":"x\\"y","n":null,"o":{"z":[1,2,"q"],"y":true}}', '{"o":{}}', '{"o":[]}', '{"o":{"z":[]}}', '{"a":1,"o":5}', "[1,[2],{\"a\":{}}]", '"s"', "3", "7.0", "true", "null", "{", "", None, ' {"é":"漢","o":{"z":[null]}} ',
    '{"a":1}}', "[1]]", "1,2", "1],[2", '1,"b":2', "1}", '{"a":1} {"b":2}', "[1],",
]
PATHS = [["a"], ["new"], ["o", "z"], ["o", "z", 0], ["o", "z", 1], ["o", "z", 5], ["o", "y"], [0], [1, 0], [2, "a"], [3]]


def test_json_edits_are_those_of_sqlite(spark):
    db = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, j string")
    columns = {}
    for k, path in enumerate(PATHS):
        columns |= {f"set{k}": json_edit.json_set(F.col("j"), path, F.lit('{"v": [1, "w"]}')), f"removed{k}": json_edit.json_remove(F.col("j"), path), f"type{k}": json_edit.json_type(F.col("j"), path)}
    for r in df.select("i", "j", json_edit.json_valid(F.col("j")).alias("valid"), json_edit.json_type(F.col("j")).alias("root"), *(c.alias(n) for n, c in columns.items())).collect():
        text = r["j"]
        valid = db.execute("SELECT json_valid(?)", [text]).fetchone()[0]
        assert r["valid"] == (None if text is None else bool(valid)), text
        if not valid:
            assert all(r[f"set{k}"] == text and r[f"removed{k}"] == text and r[f"type{k}"] is None for k in range(len(PATHS)))
            continue
        assert r["root"] == db.execute("SELECT json_type(?)", [text]).fetchone()[0]
        for k, path in enumerate(PATHS):
            p = "$" + "".join(f"[{x}]" if isinstance(x, int) else f'."{x}"' for x in path)
            assert r[f"type{k}"] == db.execute("SELECT json_type(?, ?)", [text, p]).fetchone()[0], (text, path)
            assert json.loads(r[f"removed{k}"]) == json.loads(db.execute("SELECT json_remove(?, ?)", [text, p]).fetchone()[0]), (text, path)
            want = json.loads(db.execute("SELECT json_set(?, ?, json(?))", [text, p, '{"v": [1, "w"]}']).fetchone()[0])
            parent = db.execute("SELECT json_type(?, ?)", [text, "$" + "".join(f"[{x}]" if isinstance(x, int) else f'."{x}"' for x in path[:-1])]).fetchone()[0]
            if parent in ("object", "array"):  # a way that is missing is not made
                assert json.loads(r[f"set{k}"]) == want, (text, path)
                assert parent != "object" or list(json.loads(r[f"set{k}"])) == list(want)  # members keep their order


def _bank(spark):
    q = "id int, stem string, content_version long, updated_at_ms long, deleted_at_ms long"
    return {
        "questions": spark.createDataFrame([(1, "a", 1, 0, None), (2, "b", 4, 0, None), (3, "c", 1, 0, 5)], q),
        "options": spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "question_id int, position int, text string"),
        "tags": spark.createDataFrame([(1, "t"), (2, "t")], "question_id int, tag_id string"),
        "refs": spark.createDataFrame([(1, "r")], "question_id int, resource_id string"),
        "history": spark.createDataFrame([(2, k, k, "{}") for k in range(-60, 4)], "question_id int, content_version long, saved_at_ms long, snapshot string"),
        "receipts": spark.createDataFrame([], "operation_id string, request_hash string, result_json string, created_at_ms long, completed_at_ms long"),
    }


ITEM = "operation_id string, client_id string, question_id int, expected_version long, stem string, options array<string>, tags array<string>, refs array<string>"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_overwrites_are_whole_and_happen_once(spark):
    items = [
        ("p", "1", 1, 1, "A", ["k", "l"], ["u", "u"], None), ("p", "2", 2, 4, "B", None, ["t"], ["s"]), ("q", "1", 1, 1, "late", [], [], []), ("r", "1", 3, 1, "bin", [], [], []),
        ("s", "1", 2, 3, "old", [], [], []), ("v", "1", 1, None, "no version", [], [], []), ("w", "1", 1, 1, "twice", [], [], []), ("w", "1", 2, 4, "twice", [], [], []), ("x", "1", 9, 1, "missing", [], [], []),
    ]
    df = spark.createDataFrame(items, ITEM)
    once, outcomes = overwrites.overwritten(_bank(spark), df, 77)
    assert {r["operation_id"]: r["outcome"] for r in outcomes.collect()} == {"p": "applied", "q": "version", "r": "version", "s": "version", "v": "invalid", "w": "invalid", "x": "version"}
    assert _rows(once["questions"]) == [(1, "A", 2, 77, None), (2, "B", 5, 77, None), (3, "c", 1, 0, 5)]
    assert _rows(once["options"]) == [(1, 0, "k"), (1, 1, "l")] and _rows(once["tags"]) == [(1, "u"), (2, "t")] and _rows(once["refs"]) == [(2, "s")]
    kept = once["history"].where("question_id = 2")
    assert kept.count() == 50 and kept.agg(F.min("content_version"), F.max("content_version")).first()[:] == (-45, 5)
    snapshot = json.loads(once["history"].where("question_id = 1").first()["snapshot"])
    assert (snapshot["stem"], snapshot["content_version"], snapshot["tags"], [o["text"] for o in snapshot["options"]]) == ("A", 2, ["u"], ["k", "l"])
    assert json.loads(once["receipts"].first()["result_json"])[1] == {"client_id": "2", "question_id": 2, "content_version": 5}
    twice, again = overwrites.overwritten(once, df, 78)
    assert {r["outcome"] for r in again.where("operation_id = 'p'").collect()} == {"replay"} and all(_rows(twice[t]) == _rows(once[t]) for t in once)
    other = overwrites.overwrite_outcomes(once, df.withColumn("stem", F.lit("else"))).where("operation_id = 'p'").first()["outcome"]
    many = overwrites.overwrite_outcomes(_bank(spark), df.where("operation_id = 'p'"), most=1).first()["outcome"]
    assert (other, many) == ("conflict", "invalid")


def test_a_version_comes_back_as_a_new_one(spark):
    full = _bank(spark)
    old = history.snapshots(full["questions"], full["options"], full["tags"])
    full["history"] = old.join(full["questions"].select("id", "content_version"), "id").select(F.col("id").alias("question_id"), "content_version", F.lit(0).cast("long").alias("saved_at_ms"), "snapshot")
    change = spark.createDataFrame([("p", "1", 1, 1, "A", ["k"], ["u"], ["new"])], ITEM)
    changed, _ = overwrites.overwritten(full, change, 10)
    asked = spark.createDataFrame([(1, 1, 2), (2, 4, 3), (2, 3, 4), (5, 1, 1)], "question_id int, content_version long, expected_version long")
    known = spark.createDataFrame([("t",), ("u",)], "tag_id string")
    back, outcomes = overwrites.restored(changed, asked, known, 11)
    assert {r["question_id"]: r["outcome"] for r in outcomes.collect()} == {1: "restored", 2: "version", 5: "missing"}
    assert _rows(back["questions"])[0] == (1, "a", 3, 11, None)
    assert [_rows(back[t].where("question_id = 1")) for t in ("options", "tags", "refs")] == [[(1, 0, "x")], [(1, "t")], [(1, "new")]]
    assert sorted(r["content_version"] for r in back["history"].where("question_id = 1").collect()) == [1, 2, 3]
    _, lost = overwrites.restored(changed, asked, known.where("tag_id = 'u'"), 11)
    assert {r["question_id"]: (r["outcome"], r["lost"]) for r in lost.collect()}[1] == ("lost", ["t"])
    _, gone = overwrites.restored(changed, asked, known, 11, F.col("stem") == "a")
    assert {r["question_id"]: r["outcome"] for r in gone.collect()}[1] == "lost"


def test_merges_of_a_kind_into_a_keeper(spark):
    q = spark.createDataFrame([(i, ["t"], 1, None, p) for i, p in enumerate(["x", "x", "y", None, None, "z", "z"])], "id int, tags array<string>, content_version long, deleted_at_ms long, fingerprint string")
    asked = [("a", 0, 1, 1, "exact"), ("a", 1, 1, 1, "exact"), ("b", 2, 1, 2, "exact"), ("b", 5, 1, 2, "exact"), ("c", 3, 1, 3, "exact"), ("c", 4, 1, 3, "exact"), ("d", 5, 1, 0, "suspected"), ("d", 6, 1, 0, "suspected")]
    shape = "group_id string, id int, expected_version long, keeper_id int, kind string"
    binned = lambda rows: sorted(r["id"] for r in dedup.merge_checked(q, spark.createDataFrame(rows, shape), 9).where("deleted_at_ms = 9").collect())
    assert binned(asked) == [0] and binned([(*x[:4], "suspected") for x in asked[:6]]) == [0, 4, 5] and binned([(*x[:4], "other") for x in asked]) == []


def test_names_in_the_order_of_the_language(spark):
    names = ["语文", "数学", "abc", "ABC", "地理", None, "历史", "数学"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    got = [r["name"] for r in stats.by_name(df).orderBy("place").collect()]
    assert got == [None, "地理", "历史", "数学", "数学", "语文", "abc", "ABC"] != sorted(x or "" for x in names)
    ranked = [r["name"] for r in stats.ranking_by_name(df.where("name is not null"), ["name"]).orderBy("place").collect()]
    assert ranked == ["数学", "地理", "历史", "语文", "abc", "ABC"]
    taken = bank.same_names(df.where("id > 2"), spark.createDataFrame([(3, "abc"), (70, " aBc "), (71, "x")], "id int, name string")).collect()
    assert [tuple(r) for r in taken] == [(70, " aBc ", 3)]


def test_periods_where_summer_time_begins_and_ends(spark):
    times = ["2024-03-30 22:30:00", "2024-03-31 00:30:00", "2024-03-31 12:00:00", "2024-04-01 00:00:00", "2024-10-27 00:30:00", "2024-10-27 23:30:00"]
    df = spark.createDataFrame([(x,) for x in times], "t string").select(F.to_timestamp("t").alias("t"))
    got = df.select(*(F.date_format(period_start(F.col("t"), w, "Europe/Berlin"), "MM-dd HH").alias(w) for w in ("day", "week", "month"))).collect()
    assert [tuple(r) for r in got] == [
        ("03-29 23", "03-24 23", "02-29 23"), ("03-30 23", "03-24 23", "02-29 23"), ("03-30 23", "03-24 23", "02-29 23"), ("03-31 22", "03-31 22", "03-31 22"), ("10-26 22", "10-20 22", "09-30 22"), ("10-27 23", "10-27 23", "09-30 22"),
    ]
    with pytest.raises(ValueError):
        period_start(F.col("t"), "year", "UTC")


def test_autosaved_drafts(spark):
    shape = "draft_key string, kind string, target_id int, base_version long, payload string"
    drafts = spark.createDataFrame([("a", "question_create", None, None, "old", 1, 2), ("b", "word_import_preview", None, None, "old", 1, 2), ("z", "question_edit", 9, 1, "other", 1, 2)], f"{shape}, created_at_ms long, updated_at_ms long")
    saves = [("a", "question_create", None, None, "x", 1), ("a", "question_create", None, None, "y", 2), ("b", "question_create", None, None, "x", 1), ("c", "question_edit", 5, 3, "x", 1), ("d", "question_edit", 6, 1, "x", 1), ("e", "question_edit", None, 1, "x", 1), ("f", "question_create", 5, None, "x", 1)]
    after, outcomes = history.drafts_saved(drafts, spark.createDataFrame(saves, f"{shape}, ordinal int"), spark.createDataFrame([(5,)], "id int"), 50)
    assert dict(map(tuple, outcomes.collect())) == {"a": "saved", "b": "other kind", "c": "saved", "d": "no target", "e": "no target", "f": "extra target"}
    assert _rows(after) == [("a", "question_create", None, None, "y", 1, 50), ("b", "word_import_preview", None, None, "old", 1, 2), ("c", "question_edit", 5, 3, "x", 50, 50), ("z", "question_edit", 9, 1, "other", 1, 2)]


def test_several_json_edits_at_once_are_those_one_by_one(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "j string")
    value, bad, j = F.lit('{"z":[1,{"y":2}]}'), F.lit("{"), F.col("j")
    several = [
        [(["a"], value), (["a", "z", 1, "y"], F.lit("3")), (["a", "z", 2], F.lit('"n"')), (["b"], None)],
        [(["o", "z"], bad), (["o", "z", 0], None), (["new"], value), (["a"], None)],
        [([1], value), ([1, "z", 0], None), ([0], None), (["a", "z", 0], bad)],
    ]
    for edits in several:
        each = df.withColumn("each", j)
        for path, v in edits:
            each = each.withColumn("each", json_edit.json_remove(F.col("each"), path) if v is None else json_edit.json_set(F.col("each"), path, v)).localCheckpoint()
        for r in each.withColumn("at_once", json_edit.json_edited(j, edits)).collect():
            if r["at_once"] == r["each"]:
                continue
            assert json.loads(r["at_once"]) == json.loads(r["each"]), r
            assert repr(json.loads(r["at_once"])) == repr(json.loads(r["each"])), r  # members keep their order
    with pytest.raises(ValueError):
        json_edit.json_edited(j, [([], value)])
