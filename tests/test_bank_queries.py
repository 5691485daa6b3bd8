"""Every bank query against its SQL on the smallest test tables, and rules that need small literal rows."""

import os

import pytest
from pyspark.sql import functions as F

from quillbank.functions import text as T
from quillbank.functions.tables import numbered
from quillbank.operators import dedup, history, listing, papers, sampling
from quillbank.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare, connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    assert compare(spark, FOLDER, name, QUERIES[name], ORACLE_SQL[name], sql) == ""


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_equal_content_has_equal_fingerprints(spark):
    rows = [("ＡＢＣ 教育", "答案 A"), ("abc\u0085教育", "答案a"), ("abc教育", "答案 B")]
    df = spark.createDataFrame(rows, "stem string, answer string")
    prints = [r[0] for r in df.select(T.content_fingerprint(F.lit("short"), [F.col("stem"), F.col("answer")])).collect()]
    assert prints[0] == prints[1] != prints[2]


def test_dice_percent(spark):
    def dice(a, b):
        pairs = spark.createDataFrame([(1, 2)], "left_id int, right_id int")
        return dedup.pair_similarity(pairs, spark.createDataFrame([(1, a), (2, b)], "id int, text string")).first()["similarity"]

    assert dice("abcd", "abcd") == 100 and dice("abc", "") == 0 and dice("a", "a") == 100 and dice("a", "b") == 0
    assert dice("aaaa", "aa") == 50 and dice("night", "nacht") == 25


def test_keyword_wildcards_and_ascii_case(spark):
    df = spark.createDataFrame([("ÄBC",), ("a_c",), ("a\\b",), (None,)], "s string")
    found = lambda k, **o: [r[0] for r in df.where(T.matches_keyword([F.col("s")], k, **o)).collect()]
    assert found("äbc") == [] and found("Äbc") == ["ÄBC"] and set(found("A_")) == {"a_c", "a\\b"}
    assert found("a_", escape_wildcards=True) == ["a_c"] and found("\\") == ["a\\b"]


def test_text_helpers(spark):
    assert _one(spark, T.split_tags(F.col("x")), x=" a、B;b,c\n ") == ["a", "B", "c"]
    assert _one(spark, T.option_lines(F.array(*[F.lit(str(i)) for i in range(27)])), x=1).split("\n")[25:] == ["Z. 25", "27. 26"]
    assert _one(spark, T.percent_text(F.col("a"), F.col("b")), a=1, b=0) == "0.0" and _one(spark, T.percent_text(F.col("a"), F.col("b")), a=1, b=3) == "33.3"
    assert _one(spark, T.stem_preview(F.col("x")), x=" a \n b" + "c" * 200).endswith("c…")
    assert _one(spark, T.cell_text(F.col("x"), 10, "~"), x="ab\u0001" + "c" * 20) == "ab" + "c" * 7 + "~"
    assert _one(spark, T.utc_text(F.col("x")), x=1000) == "1970-01-01 00:00:01 UTC"
    assert _one(spark, T.header_key(F.col("x")), x="Ｓtem _-：Text") == "stemtext"


def test_usage_windows(spark):
    now = 1_700_000_000_000  # Tuesday 2023-11-14 22:13:20
    day, week, month = (spark.range(1).select(T.usage_cutoff_ms(w, now)).first()[0] for w in ("day", "week", "month"))
    assert (day, week, month) == (1_699_920_000_000, 1_699_833_600_000, 1_698_796_800_000)
    with pytest.raises(ValueError):
        T.usage_cutoff_ms("year", now)


def test_numbered_is_the_sorted_order(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    assert all(r["x"] == r["position"] for r in numbered(df, [F.asc("x")]).collect())
    assert numbered(df.limit(0), [F.asc("x")]).count() == 0


def test_drawing(spark):
    q = spark.createDataFrame([(i, "ab"[i % 2], "s") for i in range(20)], "id int, question_type string, subject string")
    bridge = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (3, "y")], "question_id int, tag_id string")
    assert {r["id"] for r in sampling.draw_scope(q, bridge, tags=("x", "y"), excluded=(1,)).collect()} == {2, 3}
    assert {r["id"] for r in sampling.draw_scope(q, bridge, tags=("x", "y"), tag_mode="all").collect()} == {3}
    assert sampling.draw_total(q, 1000).count() == 20
    drawn = sampling.draw_by_type(q, {"a": 3, "b": 1}, seed=1).collect()
    assert sorted(r["question_type"] for r in drawn) == ["a", "a", "a", "b"]
    with pytest.raises(ValueError):
        sampling.draw_total(q, 0)


def test_pages_together_are_the_whole_list(spark):
    q = spark.createDataFrame([(i, i % 3, "s") for i in range(25)], "id int, updated_at int, stem_plain string")
    pages = [[r["id"] for r in listing.list_questions(q, listing.QuestionFilters(page=p, page_size=10)).collect()] for p in (1, 2, 3, 4)]
    assert sum(pages, []) == [r["id"] for r in q.orderBy(F.desc("updated_at"), "id").collect()] and pages[3] == []


def test_draft_staleness(spark):
    drafts = spark.createDataFrame([(1, "question_edit", 1, 3), (2, "question_edit", 2, 3), (3, "question_edit", 9, 3), (4, "question_create", None, None)], "draft_id int, kind string, target_id int, base_version int")
    current = spark.createDataFrame([(1, 3), (2, 4)], "id int, content_version int")
    assert {r["draft_id"]: r["stale"] for r in history.stale_drafts(drafts, current).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_merging_bins_all_but_the_keeper(spark):
    q = spark.createDataFrame([(1, 1, None), (2, 5, None), (3, 1, None)], "id int, content_version int, deleted_at_ms long")
    got = {r["id"]: (r["content_version"], r["deleted_at_ms"]) for r in dedup.merged(q, spark.createDataFrame([(7, 1), (7, 2)], "group_id int, id int"), 99).collect()}
    assert got == {1: (2, None), 2: (6, 99), 3: (1, None)}


def test_upserts_need_the_present_version(spark):
    table = spark.createDataFrame([(1, "a", 1, 0), (2, "b", 4, 0)], "id int, stem string, content_version int, updated_at_ms long")
    changes = spark.createDataFrame([(1, "A", 1), (2, "B", 3), (3, "C", None), (4, "D", 2)], "id int, stem string, expected_version int")
    got = {r["id"]: (r["stem"], r["content_version"]) for r in history.upserted(table, changes, 9).collect()}
    assert got == {1: ("A", 2), 2: ("b", 4), 3: ("C", 1)}
    assert {r["id"] for r in history.conflicts(table, changes).collect()} == {2, 4}


def test_replays_and_tag_edits(spark):
    out = history.split_replays(spark.createDataFrame([(1, "h"), (2, "h"), (3, "h")], "operation_id int, request_hash string"), spark.createDataFrame([(2, "h"), (3, "g")], "operation_id int, request_hash string"))
    assert {r["operation_id"]: r["outcome"] for r in out.collect()} == {1: "new", 2: "replay", 3: "conflict"}
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    row = spark.range(1).select(*(history.edited_tags(a, b, m) for m in ("keep", "append", "replace", "remove"))).first()
    assert tuple(row) == (["x", "y"], ["x", "y", "z"], ["y", "z"], ["x"])


def test_swap_with_neighbour_of_the_type(spark):
    items = spark.createDataFrame([(1, 0, "a", "i"), (1, 1, "b", "j"), (1, 2, "a", "k")], "paper_id int, position int, question_type string, item_id string")
    assert {r["item_id"]: r["position"] for r in papers.swapped(items, 1, "i", 1).collect()} == {"i": 2, "j": 1, "k": 0}
    assert {r["item_id"]: r["position"] for r in papers.swapped(items, 1, "j", -1).collect()} == {"i": 0, "j": 1, "k": 2}


def test_ignores_hold_for_their_versions(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left_id int, right_id int")
    versions = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, content_version int")
    ignores = spark.createDataFrame([(1, 2, 1, 1), (1, 3, 1, 1)], "left_id int, right_id int, left_version int, right_version int")
    assert [r["right_id"] for r in dedup.without_ignored(pairs, versions, ignores).collect()] == [3]


def test_scan_window_is_bounded(spark):
    q = spark.range(1200).select(F.col("id"), F.lit(5).alias("length"), F.col("id").alias("updated"))
    most = dedup.window_candidates(q).groupBy("id").count().agg(F.max("count")).first()[0]
    assert most == 256
