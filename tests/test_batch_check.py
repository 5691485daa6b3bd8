"""The check of a batch against a plain walk."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillbank.operators import dedup


def _dice(a, b):
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    n = sum(x.values()) + sum(y.values())
    return min(100, (200 * sum((x & y).values()) + n // 2) // n)


def _plain(items, bank, mode, window):
    bank = sorted(bank, key=lambda r: (r[2], -r[3], r[0]))
    out, seen = {}, {}
    for at, (ordinal, text, length, print_, own) in enumerate(items):
        same = next((r[0] for r in bank if print_ and r[4] == print_ and r[0] != own), None) if mode != "import" else None
        earlier = seen.get(print_)
        if same is not None:
            out[ordinal] = ("exact", same, None, 100, 1)
        elif earlier is not None:
            out[ordinal] = ("exact", None, earlier, 100, 1)
        elif mode == "exact":
            out[ordinal] = ("none", None, None, None, 0)
        else:
            if mode == "full":
                left = [r for r in bank if r[2] < length][::-1]
                right = [r for r in bank if r[2] >= length]
            else:
                prior = items[:at]
                left = sorted((r for r in prior if r[2] <= length), key=lambda r: (-r[2], -r[0]))
                right = sorted((r for r in prior if r[2] > length), key=lambda r: (r[2], -r[0]))
            near = []
            while len(near) < window and (left or right):
                lower = left and (not right or abs(left[0][2] - length) <= abs(right[0][2] - length))
                row = (left if lower else right).pop(0)
                if mode == "import" or row[0] != own:
                    near.append(row)
            best = max(((_dice(text, r[1]), -k, r[0]) for k, r in enumerate(near)), default=None)
            if best is None or mode == "import" and best[0] < 82:
                out[ordinal] = ("none", None, None, None, len(near))
            else:
                status = "suspected" if best[0] >= 82 else "none"
                out[ordinal] = (status, best[2] if mode == "full" else None, best[2] if mode == "import" else None, min(99, best[0]), len(near))
        if print_:
            seen.setdefault(print_, ordinal)
    return out


@pytest.mark.parametrize("mode", ["full", "exact", "import"])
def test_check_batch(spark, mode):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefg", k=rng.choice([20, 21, 22]))) for _ in range(12)]

    def text():
        t = rng.choice(base)
        return t if rng.random() < 0.4 else t[: rng.randrange(18, 22)] + rng.choice("xyz")

    bank = [(i, t, len(t), rng.randrange(4), t if i % 9 else None) for i in range(60) for t in [text() if i % 2 else text() + "q"]]
    items = [(i, t, len(t), t if i % 7 else None, rng.choice([None, i])) for i in range(40) for t in [text()]]
    b = spark.createDataFrame(bank, "id long, text string, length int, updated long, fingerprint string")
    x = spark.createDataFrame(items, "ordinal long, text string, length int, fingerprint string, question_id long")
    for window in (6, 256):
        got = {r[0]: tuple(r)[1:] for r in dedup.check_batch(x, b, mode, window).collect()}
        assert got == _plain(items, bank, mode, window)
        assert mode == "exact" or {"exact", "none", "suspected"} >= {r[0] for r in got.values()} > {"exact"}


def test_grams_in_common():
    rng = random.Random(4)
    texts = ["", "a", "aa", "aaaa", "\U0001f600é\U0001f600é", *("".join(rng.choices("ab一", k=rng.randrange(1, 60))) for _ in range(40))]
    bags = [dedup.gram_bag(t) for t in texts]
    counts = [Counter([t + "\0"] if len(t) == 1 else [t[i : i + 2] for i in range(len(t) - 1)]) for t in texts]
    want = [[sum((a & b).values()) for b in counts] for a in counts[:20]]
    for tokens in (7, 1 << 17):
        assert dedup.shared_between(bags[:20], bags, tokens).tolist() == want
    assert [len(b) for b in bags] == [sum(c.values()) for c in counts] and dedup.shared_between([], bags).shape == (0, 45)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 37, 200])
def test_nearest_earlier_items(spark, n):
    rng = random.Random(n)
    lengths = [rng.choice([5, 5, 5, 6, 9, rng.randrange(50)]) for _ in range(n)]
    items = spark.createDataFrame([(3 * i, x) for i, x in enumerate(lengths)], "ordinal long, length int")
    got = {}
    for r in dedup._earlier_candidates(items, 8, items).collect():
        got.setdefault(r["ordinal"], {})[r["rank"]] = r["candidate"]
    want = {3 * i: dict(enumerate([3 * j for j in sorted(range(i), key=lambda j: (abs(lengths[j] - x), lengths[j] > x, -j))][:8], 1)) for i, x in enumerate(lengths) if i}
    assert got == want


def test_earlier_candidates_grow_with_n_log_n(spark):
    """Rows for the candidates of all items, at most window * log2(n) an item, whether lengths differ or not."""
    for kind in (lambda i: i * 7919 % 1000, lambda i: i // 600):
        for n in (1000, 2000, 4000):
            items = spark.createDataFrame([(i, kind(i)) for i in range(n)], "ordinal long, length int")
            assert dedup.earlier_pairs(items, 16).count() <= 16 * n * (n - 1).bit_length()


def test_candidates_are_found_once_a_length_and_exact_rows_once_a_text(spark):
    bank = spark.range(200).selectExpr("id", "concat('t', id % 4) text", "cast(2 + id % 4 as int) length", "id updated", "cast(id % 4 as string) fingerprint")
    lengths = spark.createDataFrame([(2,), (4,)], "length int")
    for walk in (False, True):
        near = dedup._length_candidates(lengths, bank, 60, walk).groupBy("length").count().collect()
        assert {r["length"]: r["count"] for r in near} == {2: 61, 4: 61}
    items = spark.range(90).selectExpr("id ordinal", "id % 2 * 197 question_id", "'1' fingerprint")
    found = dedup._exact_rows(items, bank, [F.desc("updated"), F.asc("id")]).collect()
    assert {r["ordinal"]: r["same"] for r in found} == {i: 193 if i % 2 else 197 for i in range(90)}
    big = 2**60
    probe = spark.createDataFrame([(1, "abcd", 4, big), (2, "abcd", 4, None)], "id long, text string, length int, question_id long")
    known = spark.createDataFrame([(big, "abcd", 4, 1), (big + 1, "abce", 4, 1)], "id long, text string, length int, updated long")
    assert {r["probe_id"]: r["candidate"] for r in dedup.best_match(probe, known).collect()} == {1: big + 1, 2: big}
