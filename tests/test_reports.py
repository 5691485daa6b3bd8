"""The duplicate report, content rules, the export order and small counts on a few rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillbank.functions.content_rules import Limits, content_bytes, content_fault
from quillbank.operators import exports, listing, resources, stats
from quillbank.operators.duplicate_report import ScopeTooLarge, scan_report
from tests.test_batch_check import _dice

QUESTIONS = "id long, text string, stem string, length int, created long, updated long, content_version int, fingerprint string, fingerprint_version int, comparable boolean, subject string"
IGNORES = "left_id long, right_id long, left_version int, right_version int"


def _plain_report(rows, subject, ignores):
    """The same report by comparing all pairs; the window is wider than the bank."""
    at = {r[0]: r for r in rows}
    print_ = {r[0]: r[7] if r[7] is not None and r[8] == 2 and r[9] else ("own", r[0]) for r in rows}
    inside = {r[0] for r in rows if r[10] == subject}
    order = lambda ids: sorted(ids, key=lambda i: (at[i][4], i))
    groups = []
    for p in set(print_.values()):
        ids = order(i for i in at if print_[i] == p)
        if len(ids) > 1 and inside & set(ids):
            groups.append(("exact", 100, f"exact:{ids[0]}", ids))
    for a in at:
        for b in at:
            if a < b and (a in inside or b in inside) and print_[a] != print_[b] and (a, b, at[a][6], at[b][6]) not in ignores:
                score = _dice(at[a][1], at[b][1]) if len(at[a][1]) > 1 and len(at[b][1]) > 1 else 0
                if score >= 82:
                    groups.append(("suspected", min(99, score), f"suspected:{a}:{b}", order([a, b])))
    groups.sort(key=lambda g: (g[0], -g[1], g[2]))
    return [(n, name, kind, score, k, i, at[i][6]) for n, (kind, score, name, ids) in enumerate(groups) for k, i in enumerate(ids)]


def _report(df):
    rows = df.orderBy("place", "member_place").collect()
    return [(r["place"], r["group_id"], r["kind"], r["similarity"], r["member_place"], r["member"], r["content_version"]) for r in rows]


def test_the_report_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh", k=rng.choice([0, 30, 31, 40]))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = list(rng.choice(base))
        if text and rng.random() < 0.7:
            text[rng.randrange(len(text))] = rng.choice("xyz")
        text = "".join(text)
        rows.append((i, text, text, len(text), rng.randrange(5), rng.randrange(9), rng.randrange(1, 3), rng.choice([None, text[:5]]), rng.choice([1, 2, 2, None]), rng.choice([True, True, False, None]), rng.choice(["s", "t", None])))
    ignores = {(a, b, rng.randrange(1, 3), rng.randrange(1, 3)) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.3}
    questions, ignored = spark.createDataFrame(rows, QUESTIONS), spark.createDataFrame(sorted(ignores), IGNORES)
    expected = _plain_report(rows, "s", ignores)
    assert {x[2] for x in expected} == {"exact", "suspected"}
    assert _report(scan_report(questions, F.col("subject") == "s", ignored)) == expected
    assert _report(scan_report(questions, F.col("subject") == "none", ignored)) == []
    assert _report(scan_report(questions.limit(0), F.lit(True), ignored)) == []
    inside = sum(r[10] == "s" for r in rows)
    assert scan_report(questions, F.col("subject") == "s", ignored, most=inside).count() == len(expected)
    with pytest.raises(ScopeTooLarge):
        scan_report(questions, F.col("subject") == "s", ignored, most=inside - 1)


CONTENT = "schema_version int, editor string, editor_version string, document string, html string, plain_text string, source_ooxml string"


def test_first_faults_of_contents(spark):
    doc, limits = json.dumps({"type": "doc"}), Limits(html=20, document=20, plain=10, ooxml=5)
    cases = [
        ((1, None, None, None, "<p>x</p>", "x", None), [None] * 4),
        ((1, None, None, None, "", " ", None), ["empty", None, None, None]),
        ((1, None, None, doc, "", "x", None), ["old version with an editor"] * 4),
        ((3, None, None, None, "", "x", None), ["unknown version"] * 4),
        ((None, None, None, None, None, None, None), ["unknown version"] * 4),
        ((2, "other", "1", doc, "", "x", None), ["unknown editor"] * 4),
        ((2, "tiptap", " ", doc, "", "x", None), ["bad editor version"] * 4),
        ((2, "tiptap", "1" * 65, doc, "", "x", None), ["bad editor version"] * 4),
        ((2, "tiptap", "1", None, "", "x", None), ["no document"] * 4),
        ((2, "tiptap", "1", "[]", "", "x", None), ["bad document"] * 4),
        ((2, "tiptap", "1", '{"type": "doc", "more": 12345}', "", "x", None), ["document too large"] * 3 + [None]),
        ((2, "tiptap", "1" * 64, doc, "", "x", None), [None] * 4),
        ((1, None, None, None, "<p>" + "中" * 6, "x", None), ["html too large"] * 3 + [None]),
        ((1, None, None, None, "<p>" + "中" * 5, "x", None), [None] * 4),
        ((1, None, None, None, "", "x" * 11, None), ["text too long"] * 3 + [None]),
        ((1, None, None, None, "", "x", "123456"), ["source too large"] * 3 + [None]),
        ((1, None, None, None, "", "a\x1eb" + "x" * 11, None), ["separator"] * 2 + ["text too long", "separator"]),
        ((1, None, None, None, "\x1f", "x", None), [None, None, "separator", "separator"]),
        ((1, None, None, None, "", "x", "\x1f"), [None, None, "separator", "separator"]),
        ((1, None, None, None, "<SCRIPT>", "", None), ["unsafe"] * 4),
    ]
    rows = spark.createDataFrame([x for x, _ in cases], CONTENT).withColumn("n", F.monotonically_increasing_id())
    c = F.struct(*(F.col(x.split()[0]) for x in CONTENT.split(", ")))
    policies = ("question", "question or empty", "draft field", "draft document")
    got = rows.select("n", *(content_fault(c, p, limits=limits).alias(p) for p in policies), content_bytes(c).alias("bytes")).orderBy("n").collect()
    assert [[r[p] for p in policies] for r in got] == [x for _, x in cases]
    assert [r["bytes"] for r in got] == [sum(len((x or "").encode()) for x in (*row[3:7],)) for row, _ in cases]
    nothing = rows.select(content_fault(c, "question", F.lit(None).cast("boolean"), limits).alias("f")).where("f = 'empty'")
    assert nothing.count() == sum(x[0] in (None, "empty") for _, x in cases)  # whatever passes until then is empty
    with pytest.raises(ValueError):
        content_fault(c, "any")


def test_the_order_of_a_whole_bank(spark):
    rng = random.Random(1)
    dimension = lambda n: [(i, rng.choice([None, 1, 2])) for i in range(n)]
    subjects, chapters, types = dimension(3), dimension(4), [(f"t{i}", s) for i, s in dimension(3)]
    rows = [(f"q{i:02d}", rng.randrange(4), rng.randrange(5), f"t{rng.randrange(4)}", rng.randrange(3)) for i in range(80)]
    frame = spark.createDataFrame(rows, "question_id string, subject_id int, chapter_id int, question_type string, created_at_ms long")
    keyed = exports.with_sort_keys(frame, spark.createDataFrame(subjects, "subject_id int, sort_order int"), spark.createDataFrame(chapters, "chapter_id int, sort_order int"), spark.createDataFrame(types, "code string, sort_order int"))
    got = [r["question_id"] for r in keyed.orderBy(*exports.EXPORT_ORDER).collect()]
    s, c, k = dict(subjects), dict(chapters), dict(types)
    place = lambda of, x: (of[x] is not None, of[x] or 0, x)
    known = [r for r in rows if r[1] in s and r[2] in c and r[3] in k]
    assert got == [r[0] for r in sorted(known, key=lambda r: (place(s, r[1]), place(c, r[2]), place(k, r[3]), r[4], r[0]))]


def test_tags_resources_and_counts_of_types(spark):
    questions = spark.createDataFrame([(1, "old"), (2, "old")], "id long, tags_plain string")
    bridge = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3), (1, 4), (1, 9), (None, 1)], "question_id long, tag_id long")
    tags = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "tag_id long, name string")
    got = {r["id"]: r["tags_plain"] for r in listing.with_tags_plain(questions, bridge, tags).collect()}
    assert got == {1: "a b b", 2: ""}
    assert listing.with_tags_plain(questions.drop("tags_plain").limit(0), bridge, tags).columns == ["id", "tags_plain"]

    refs = spark.createDataFrame([(1, "r"), (1, "r"), (1, "s"), (None, "r"), (2, None)], "question_id long, resource_id string")
    assert {tuple(r) for r in resources.resource_ids(refs).collect()} == {(1, "r", 2), (1, "s", 1)}

    facts = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("y", None), (None, "a")], "subject string, question_type string")
    got = {r["subject"]: list(r["types"].items()) for r in stats.type_counts(facts, "subject").collect()}
    assert got == {"x": [("a", 1), ("b", 2)], "y": [], None: [("a", 1)]}
