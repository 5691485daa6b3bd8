"""Vector code compression: parts of vectors become numbers of codebook entries, found by annular norm pruning.

A codebook's entries are in order of length. The length of a part and the best distance so far bound the lengths that
a nearer entry can have, as lengths of two vectors differ by their distance at most. A few entries of about the part's
length give that first distance; then binary search finds the ring of lengths it allows, both ends included, and only
that ring is evaluated, by exact integers.

Codebooks are small (16 parts of 64 entries) and go to every task. A round sends one row for each entry and component
from each task, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.llm._cluster import attached, materialised
from quillbank.llm._vectors import floored, matrices

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 2.0**26  # of scaled components, so that squared distances fit 64 bits
SLICE = 2048  # vectors evaluated at once
NEAR = 2  # entries to either side of a part's length that give the first distance


class Rings:
    """Entries of one codebook in order of length."""

    def __init__(self, entries: np.ndarray) -> None:
        length = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.place = np.argsort(length, kind="stable")
        self.length, self.entries = length[self.place], entries[self.place]

    def nearest(self, parts: np.ndarray, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, ties to the lower, and the squared distance.

        `counts` gets the number of (part, entry) pairs of the rings and of all.
        """
        n, m = len(parts), len(self.entries)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        at = np.searchsorted(self.length, own)
        some = np.clip(at[:, None] + np.arange(-NEAR, NEAR)[None], 0, m - 1)
        first = sum((parts[:, c, None] - self.entries[some, c]) ** 2 for c in range(parts.shape[1])).min(1)
        reach = np.sqrt(first.astype(np.float64)) * (1 + 1e-9) + own * 1e-9 + 1e-9
        low, high = np.searchsorted(self.length, own - reach, "left"), np.searchsorted(self.length, own + reach, "right")
        size = high - low
        begin = np.cumsum(size) - size
        inside = np.arange(size.sum()) + np.repeat(low - begin, size)
        distance = np.zeros(len(inside), np.int64)
        for mine, theirs in zip(parts.T, self.entries.T, strict=True):
            apart = np.repeat(mine, size)
            apart -= theirs[inside]
            apart *= apart
            distance += apart
        best = np.minimum.reduceat(distance, begin)
        index = np.minimum.reduceat(np.where(distance == np.repeat(best, size), self.place[inside], m), begin)
        if counts is not None:
            counts["ring"] = counts.get("ring", 0) + len(inside)
            counts["all"] = counts.get("all", 0) + n * m
        return index, best


def assign(rows: np.ndarray, books: np.ndarray, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance for each row and part; books: (parts, entries, width of a part)."""
    cut = rows.astype(np.int64).reshape(len(rows), books.shape[0], books.shape[2])
    index, distance = np.zeros(cut.shape[:2], np.int64), np.zeros(cut.shape[:2], np.int64)
    for p, entries in enumerate(books):
        rings = Rings(entries)
        for i in range(0, len(rows), SLICE):
            index[i : i + SLICE, p], distance[i : i + SLICE, p] = rings.nearest(cut[i : i + SLICE, p], counts)
    return index, distance


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number and componentwise sum of the parts nearest to each entry, for a whole task."""
        parts, entries, width = books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, rows in matrices(batch, "v"):
                index, _ = assign(rows, books)
                for p in range(parts):
                    n[p] += np.bincount(index[:, p], minlength=entries)
                    np.add.at(total[p], index[:, p], rows[:, p * width : (p + 1) * width].astype(np.int64))
        p, e = np.nonzero(n)
        columns = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(n[p, e], width), total[p, e].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SUMS, strict=True)], schema=_SUMS)

    return run


_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in matrices(batch, "v"):
                index, distance = assign(rows, books)
                code = [x.tobytes().hex() for x in index.astype(np.uint8)]
                keys = [batch.column(c).take(pa.array(at)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(code, pa.string()), pa.array(distance.sum(1), pa.int64())], schema=_CODED)

    return run


def _kept(vector: Column, parts: int) -> Column:
    """Scaled vector; null if it is not sound, cannot be cut into equal parts, or is out of range."""
    v = floored(vector, SCALE)
    return F.when((F.size(v) > 0) & (F.size(v) % parts == 0) & ~F.exists(v, lambda x: F.abs(x) > LIMIT), v)


def train_codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, width of a part) after the rounds, from rows (vec_id, v) of one width.

    What comes to the driver is the first `entries` rows, and in each round one number for an entry and component.
    """
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = np.array([r["v"] for r in rows.select("vec_id", "v").orderBy(*order).limit(entries).collect()]).astype(np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        found = rows.select("v").mapInArrow(_sums(books), "part int, entry int, position int, n long, total long")
        found = found.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = books.copy()
        for r in found.collect():
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for the rows (vec_id, embedding, label) that are kept.

    Left out: vectors that are null, hold null or non-finite components, or components beyond 2**26 / 256, whose
    squared distances need not fit 64 bits; those that cannot be cut into equal parts; and those of another width than
    the kept row of smallest vec_id. Rows that repeat a vec_id count each, in order of their vectors; null ids come
    last. With fewer rows than entries the codebooks are as much smaller. Errors of null labels are summed together,
    whatever their label's type. An empty table gives no rows. Other columns are left out.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: at most 256 entries")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), _kept(F.col("embedding"), parts).alias("v")).where("v is not null")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("width")).first()
    if first is None:
        return rows.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    rows = rows.where(F.size("v") == first["width"])
    books = train_codebooks(rows, first["width"], parts, entries, rounds)
    coded = materialised(rows.mapInArrow(_codes(books), "vec_id long, label string, code string, error long").withColumn("key", F.struct(F.col("label").isNull(), F.coalesce("label", F.lit("")))))
    errors = materialised(coded.groupBy("key").agg(F.sum("error").alias("label_error")))
    return attached(coded, errors, "key").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors."""
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT vec_id, label, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS part
  FROM kept, (SELECT unnest(range(16)) AS p)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (
  SELECT p, e, part AS entry FROM cut JOIN firsts USING (vec_id)
), near0 AS (
  SELECT vec_id, p, any_value(part) AS part, min({'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS x
  FROM cut JOIN book0 USING (p) GROUP BY vec_id, p
), mean0 AS (
  SELECT p, e, list(m ORDER BY i) AS entry FROM (
    SELECT p, x.e AS e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS m
    FROM near0, (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL) GROUP BY p, e
), book1 AS (
  SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM book0 b LEFT JOIN mean0 m ON b.p = m.p AND b.e = m.e
), near1 AS (
  SELECT vec_id, p, any_value(part) AS part, min({'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS x
  FROM cut JOIN book1 USING (p) GROUP BY vec_id, p
), mean1 AS (
  SELECT p, e, list(m ORDER BY i) AS entry FROM (
    SELECT p, x.e AS e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS m
    FROM near1, (SELECT unnest(range(1, 5)) AS i) GROUP BY ALL) GROUP BY p, e
), book2 AS (
  SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM book1 b LEFT JOIN mean1 m ON b.p = m.p AND b.e = m.e
), near2 AS (
  SELECT vec_id, any_value(label) AS label, p, min({'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS x
  FROM cut JOIN book2 USING (p) GROUP BY vec_id, p
), coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(x.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(x.d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(entry) AS c, generate_subscripts(entry, 1) AS i FROM book2)) AS codebooks_sha256
FROM coded
"""
