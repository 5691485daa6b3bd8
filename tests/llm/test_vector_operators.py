"""The vector operators against plain versions, on rows with nulls, repeats, ties, odd widths and clashing columns."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbank.llm.code_compression import OP11_SQL, Rings, compress_vectors, op11_code_compression
from quillbank.llm.hard_negatives import OP13_SQL, Anchors, Block, augmented, bracket, choose_pivots, distances, hard_negatives, op13_hard_negatives
from quillbank.llm.near_vectors import OP12_SQL, near_vectors, op12_near_vectors, plan

SHAPE = "vec_id long, embedding array<float>, label int, score double, code string, rank int, n long, v string"
SMALL = "/root/testdata/sf0.001"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 0.0, "c", 1, 2, "x") for i, v, y in rows], SHAPE).repartition(3)


def _sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


ODD = [
    (900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] + [0.5] * 15, 1), (903, [float("inf")] * 16, 2),
    (904, [0.25] * 5, 1), (905, [], 1), (906, [0.0] * 16, 1), (907, [0.0] * 16, 1), (None, [0.5] * 16, 1), (None, [0.5] * 16, None),
]


@pytest.fixture(scope="module")
def rows():
    """Vectors of 16 components: near and exact copies, a third of all in one group, repeated ids, null labels."""
    rng = np.random.default_rng(5)
    near = lambda c, e: (c + rng.normal(0, e, 16)).astype(np.float32).tolist()
    centres = rng.normal(0, 1, (12, 16))
    out = [(i, near(centres[i % 12], (0.02, 0.2, 0.6)[i % 3]), int(rng.integers(0, 4)) if i % 9 else None) for i in range(240)]
    out += [(300 + i, near(centres[0], 0.1), 1) for i in range(90)] + [(400 + i, out[4][1], 2) for i in range(30)]
    out += [out[4], (4, near(centres[1], 0.1), 1), (500, [2 * x for x in out[4][1]], out[4][2]), (501, [-x for x in out[4][1]], out[4][2])]
    return out + ODD


def _plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if _sound(v) and v and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    books = [[r[1][p * w : (p + 1) * w] for r in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                part = v[p * w : (p + 1) * w]
                members[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else e for j, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for i, v, y in kept:
        found = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), y))
        by[y] += out[-1][2]
    return sorted(((i, c, e, by[y], sha) for i, c, e, y in out), key=str)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (16, 64, 2), (2, 3, 1)])
def test_code_compression(spark, rows, parts, entries, rounds):
    got = compress_vectors(_frame(spark, rows), parts, entries, rounds).collect()
    assert sorted(map(tuple, got), key=str) == _plain_codes(rows, parts, entries, rounds)


def test_code_compression_of_few_and_none(spark, rows):
    few = [(7, [0.5] * 16, None), (8, [0.5] * 16, None), (9, [-0.125] * 16, 3)]
    assert sorted(map(tuple, compress_vectors(_frame(spark, few)).collect()), key=str) == _plain_codes(few, 16, 64, 2)
    for none in ([], ODD[:4]):
        got = compress_vectors(_frame(spark, none))
        assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_only_the_ring_is_evaluated():
    rng = np.random.default_rng(3)
    entries = (rng.normal(0, 1, (64, 4)) * rng.uniform(1, 3000, (64, 1))).astype(np.int64)
    entries[10] = entries[50]
    parts = np.concatenate([entries, (rng.normal(0, 1, (400, 4)) * rng.uniform(1, 3000, (400, 1))).astype(np.int64), np.zeros((3, 4), np.int64)])
    counts = {}
    index, distance = Rings(entries).nearest(parts, counts)
    full = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (distance == full.min(1)).all() and index[50] == 10
    assert counts["ring"] < 0.6 * counts["all"]


def _plain_links(rows, cosine):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    live = [j for j, (_, v, y) in enumerate(rows) if y is not None and _sound(v) and any(v)]
    links, root = defaultdict(set), list(range(len(rows)))
    for a in live:
        for b in live:
            x, y = rows[a][1], rows[b][1]
            if a < b and rows[a][2] == rows[b][2] and len(x) == len(y):
                dot = sum(p * q for p, q in zip(x, y))
                if dot / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)) >= cosine:
                    links[a].add(b), links[b].add(a)
    seen, out = set(), []
    for a in range(len(rows)):
        if a not in seen:
            todo, group = [a], set()
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += links[x]
            seen |= group
            least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
            out += [(rows[x][0], len(links[x]), least, rows[x][0] == least) for x in group]
    return sorted(out, key=str)


@pytest.mark.parametrize(("occupancy", "block"), [(1024, 1024), (4, 16), (16, 7)])
def test_near_vectors(spark, rows, occupancy, block):
    """With small buckets and blocks too, all links are found here, and each is counted once."""
    got = near_vectors(_frame(spark, rows), recall=0.99999, occupancy=occupancy, block=block).collect()
    assert sorted(map(tuple, got), key=str) == _plain_links(rows, 0.93)


def test_recall_at_the_threshold(spark):
    """Pairs of cosines just above the threshold, with buckets of about 4 of 2,000 vectors: at least 0.9 are found."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1000):
        x, y = rng.normal(0, 1, (2, 32))
        x, y = x / np.linalg.norm(x), y - x * (x @ y) / (x @ x)
        c = rng.uniform(0.9305, 0.935)
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, (c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist(), 1)]
    got = {r["vec_id"]: r for r in near_vectors(_frame(spark, rows), occupancy=4).collect()}
    found = sum(got[2 * i + 1]["component_id"] == 2 * i for i in range(1000))
    assert found >= 900 and all(r["component_id"] in (i, i - 1) for i, r in got.items())
    assert plan(10**8)[1] < 1000**0.25 * plan(10**5)[1]


def test_near_vectors_of_an_empty_table(spark):
    got = near_vectors(_frame(spark, []))
    assert got.count() == 0 and got.columns == ["vec_id", "n_links", "component_id", "kept"]


def _plain_negatives(rows, every, positives=5, negatives=3):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and _sound(v)]
    anchors, out = {}, []
    for i, v, y in kept:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, y) for i, w, y in kept if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [64 << 20, 6000])
def test_hard_negatives(spark, rows, group_bytes):
    """With groups of some 30 vectors too, so that anchors go to them in waves."""
    got = hard_negatives(_frame(spark, rows), F.col("vec_id") % 4 == 0, group_bytes=group_bytes).collect()
    want = _plain_negatives(rows, 4)
    assert sorted(map(tuple, got)) == want and len(want) > 300


def test_hard_negatives_of_few_and_none(spark):
    assert hard_negatives(_frame(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives(_frame(spark, ODD), F.col("vec_id") % 2 == 0).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.7, 0.1], 2), (3, [0.7, 0.1], 2), (4, [-1.0, 0.0], 1), (6, [0.0, 1.0], 3)]
    assert sorted(map(tuple, hard_negatives(_frame(spark, few), F.col("vec_id") % 2 == 0).collect())) == _plain_negatives(few, 2)


def test_brackets_hold_and_leave_out_groups():
    rng = random.Random(2)
    noise = np.random.default_rng(2)
    centres = noise.normal(0, 300, (10, 24))
    rows = np.round(centres[np.arange(4000) % 10] + noise.normal(0, 12, (4000, 24)))
    square = float((rows**2).sum(1).max())
    pivots = augmented(choose_pivots(rows[:300], 12), square)
    anchors = rows[rng.sample(range(4000), 40)]
    own, apart = distances(np.concatenate([anchors, np.zeros((40, 1))], 1), pivots), distances(augmented(rows, square), pivots)
    squares = (anchors**2).sum(1) + square
    for i in range(40):
        top, bottom = bracket(own[i], apart, apart, np.full(4000, squares[i]))
        score = rows @ anchors[i]
        assert (bottom <= score).all() and (score <= top).all()
    counts, order = {}, np.lexsort((apart.min(1), apart.argmin(1)))
    found = Anchors(np.arange(40) - 100, np.zeros(40, np.int64), anchors, pivots, square, True, np.full((40, 1), -np.inf), np.full((40, 1), np.inf))
    for part in np.array_split(order, 20):
        Block(part, np.zeros(len(part), np.int64), rows[part], apart[part]).meet(found, 3, counts)
    for i in range(40):
        score = (rows @ anchors[i]).astype(int)
        assert found.best[i, 0][1].tolist() == sorted(score.tolist(), reverse=True)[:3]
    assert counts["verified"] < 0.6 * 40 * 4000 and counts["block"] > 0 and sum(counts.values()) == 40 * 4000


@pytest.mark.parametrize(("query", "sql"), [(op11_code_compression, OP11_SQL), (op12_near_vectors, OP12_SQL), (op13_hard_negatives, OP13_SQL)])
def test_queries_and_their_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = query(spark, SMALL).select(names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
