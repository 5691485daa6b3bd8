"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are put into buckets by length, from the longest down, so that a bucket's vectors have about one length. Queries
go in blocks, and meet the buckets in waves: the longest bucket first, then each time a multiple of all before. After
each wave a query has a floor: its k-th best score so far. Divided by the query's own length and a bucket's largest, it
is a local threshold on the cosine, above 1 of which the bucket is left out. As lengths fall from bucket to bucket, the
buckets that are left are the first ones, so a query needs one number, which a small table of lengths gives, and only
goes to groups of buckets up to there. A task has a group of buckets and raises the floors from bucket to bucket.

Inside a bucket a query's candidates are found by length or by coordinate, whichever leaves fewer: by length, only a
leading part of the bucket (which is in order of length) can reach the floor; by coordinate, a candidate's normalised
value at the query's largest coordinates must lie in an interval that follows from the threshold, and the number of
those is read from sorted columns. Where both leave most of a bucket, the queries of the block that are left share one
matrix product. What is left is verified by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbank.llm._cluster import materialised, partitions

K = 10
SCALE = 1024
BUCKET_ROWS = 4096
GROUP_BYTES = 64 << 20  # of the buckets that one task holds
QUERY_BLOCK = 256
WAVE = 4  # each wave takes so many times the buckets of all before
FOCUS = 4
GATHERED = 8  # how many times the cost of a row in a matrix product a single candidate has
BINS = 1024  # of lengths, for each power of two
_EXACT = 2.0**53


def scaled(vector: Column) -> Column:
    """floor(1024 x) of each component, as double; null for a vector that is null or has null or non-finite components."""
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    if np.abs(queries).max() * np.abs(rows).max() * queries.shape[1] < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def feasible(q: float, cosine: float) -> tuple[float, float]:
    """The range of one coordinate of unit vectors whose cosine with a unit vector, which has q there, is so high."""
    spread = float(np.sqrt((1 - cosine**2) * max(0.0, 1 - q**2)))
    return (-1.0 if q <= -cosine else q * cosine - spread), (1.0 if q >= cosine else q * cosine + spread)


class Bucket:
    """Vectors in order of falling length, with columns of their normalised values in order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        length = np.sqrt((rows**2).sum(1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.rows, self.length = ids[order], rows[order], length[order]
        self.top = float(self.length[0]) if len(rows) else 0.0
        self.unit = self.rows / np.maximum(self.length, 1e-300)[:, None]
        self.columns: dict[int, np.ndarray] = {}

    def column(self, f: int) -> np.ndarray:
        if f not in self.columns:
            self.columns[f] = np.sort(self.unit[:, f])
        return self.columns[f]

    def candidates(self, query: np.ndarray, own: float, floor: float) -> tuple[str, np.ndarray | int]:
        """How the query is pruned here, and its candidates: their places, or how many of the first rows."""
        slack = 1e-9
        if floor <= 0 or own == 0 or self.top == 0:
            return "none", len(self.rows)
        cosine = floor / (own * self.top)
        if cosine > 1 + slack:
            return "bucket", 0
        leading = int(np.searchsorted(-self.length, -(floor / own) * (1 - slack), "right"))
        unit, cosine = query / own, min(1.0, cosine)
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        limits = [feasible(float(unit[f]), cosine) for f in focus]
        counts = [int(np.searchsorted(self.column(f), high + slack, "right") - np.searchsorted(self.column(f), low - slack, "left")) for f, (low, high) in zip(focus.tolist(), limits, strict=True)]
        if GATHERED * min(counts, default=leading) < leading or min(counts, default=leading) < leading and leading == len(self.rows):
            left = np.ones(leading, bool)
            for f, (low, high) in zip(focus.tolist(), limits, strict=True):
                left &= (self.unit[:leading, f] >= low - slack) & (self.unit[:leading, f] <= high + slack)
            at = np.flatnonzero(left)
            if GATHERED * len(at) < leading:
                return "coordinate", at
        return "length", leading

    def search(self, query_ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int, counts: dict[str, int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, ids, scores): the best k here of each query, among those that reach its floor.

        A query does not meet the row of its own id. `counts` gets the number of (query, vector) pairs by how they went.
        """
        leading: dict[int, int] = {}
        for i in range(len(queries)):
            how, found = self.candidates(queries[i], float(own[i]), float(floors[i]))
            n = found if isinstance(found, int) else len(found)
            if counts is not None:
                counts[how] = counts.get(how, 0) + len(self.rows) - n
                counts["verified"] = counts.get("verified", 0) + n
            if isinstance(found, int):
                if found:
                    leading[i] = found
            else:
                yield i, *self._answer(query_ids[i], self.ids[found], _products(queries[i : i + 1], self.rows[found])[0], floors[i], k)
        if leading:
            at = np.array(sorted(leading, key=leading.get))
            ends = np.array([leading[i] for i in at])
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ends * 8 // max(1, len(self.rows)))) + 1):  # of about one length
                scores = _products(queries[at[part]], self.rows[: ends[part].max()])
                for i, s in zip(at[part].tolist(), scores, strict=True):
                    yield i, *self._answer(query_ids[i], self.ids[: len(s)], s, floors[i], k)

    @staticmethod
    def _answer(query: int, ids: np.ndarray, scores: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        take = np.flatnonzero((scores >= floor) & (ids != query))
        take = take[_best(ids[take], scores[take], k)]
        return ids[take], scores[take]


_PACK = "bucket int, kind int, width int, top double, ids binary, matrix binary, floors binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("width", pa.int32()), ("top", pa.float64()), ("ids", pa.binary()), ("matrix", pa.binary()), ("floors", pa.binary())])


def _packs(kind: int, size: int):
    """Rows (vec_id, v, floor, last) as matrices of at most `size` vectors of one width each.

    Of candidates (kind 0) the bucket is the partition, and top their largest length; of queries (kind 1) it is the
    largest number of a bucket that one of them needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def out(width: int) -> pa.RecordBatch:
            ids, rows, floors, last = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
            top = float(np.sqrt((rows**2).sum(1)).max())
            values = [[int(last.max()) if kind else partition], [kind], [width], [top], [ids.tobytes()], [rows.tobytes()], [floors.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(values, _PACKED, strict=True)], schema=_PACKED)

        for batch in batches:
            column, floor, last = batch.column("v"), batch.column("floor").to_numpy(False), batch.column("last").to_numpy(False)
            begin, values, ids = column.offsets.to_numpy(), column.values.to_numpy(False), batch.column("vec_id").to_numpy()
            widths = np.diff(begin)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                rows = values[begin[at][:, None] + np.arange(width)[None]]
                for lo in range(0, len(at), size):
                    part = slice(lo, lo + size)
                    held.setdefault(width, []).append((ids[at[part]], rows[part], floor[at[part]], last[at[part]]))
                    if sum(len(x[0]) for x in held[width]) >= size:
                        yield out(width)
        for width in list(held):
            yield out(width)

    return run


_SHAPE = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block of queries through the buckets of its group, the longest first; the best k of each query."""
        group, tables = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["grouped"] != group:
                    group, tables = row["grouped"], []
                width = row["width"]
                ids, rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["matrix"], np.float64).reshape(len(row["ids"]) // 8, width)
                if row["kind"] == 0:
                    tables.append((width, Bucket(ids, rows)))
                    continue
                floors, own = np.frombuffer(row["floors"], np.float64).copy(), np.sqrt((rows**2).sum(1))
                best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for _, table in sorted((t for t in tables if t[0] == width), key=lambda t: -t[1].top):
                    for i, some, scores in table.search(ids, rows, own, floors, k):
                        if i in best:
                            some, scores = np.concatenate([best[i][0], some]), np.concatenate([best[i][1], scores])
                            at = _best(some, scores, k)
                            some, scores = some[at], scores[at]
                        best[i] = some, scores
                        if len(scores) == k:
                            floors[i] = max(floors[i], float(scores.min()))
                columns = [np.concatenate([np.full(len(x[0]), ids[i]) for i, x in best.items()] or [np.zeros(0)]), *(np.concatenate([x[j] for x in best.values()] or [np.zeros(0)]) for j in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], schema=_SHAPE)

    return run


def _met(tables: DataFrame, blocks: DataFrame, low: int, high: int, size: int, n: int, k: int) -> DataFrame:
    """Every block of queries with the buckets from low to high - 1 that it needs, in groups of `size`."""
    grouped = tables.where((F.col("bucket") >= low) & (F.col("bucket") < high)).withColumn("grouped", F.floor((F.col("bucket") - low) / size).cast("int"))
    ends = F.floor((F.least(F.col("bucket"), F.lit(high - 1)) - low) / size).cast("int")
    many = blocks.where(F.col("bucket") >= low).withColumn("grouped", F.explode(F.sequence(F.lit(0), ends)))
    both = grouped.unionByName(many).repartition(max(n, -(-(high - low) // size)), "grouped").sortWithinPartitions("grouped", "kind", "bucket")
    return both.mapInArrow(_search(k), "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bin(length: Column) -> Column:
    """Number of the bin of a length; lengths above 2**64 share one, as do those below 2**-64."""
    return F.floor(F.log2(F.least(F.greatest(length, F.lit(2.0**-64)), F.lit(2.0**64))) * BINS).cast("int")


def _reach(tables: DataFrame) -> DataFrame:
    """(bin, last): for each bin of lengths from the least to the largest, the last bucket that has a length there or above.

    The bins are at most 128 * BINS, so one task can hold them.
    """
    ends = tables.groupBy(_bin(F.col("top")).alias("bin")).agg(F.max("bucket").alias("bucket"))
    span = ends.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("bin"))
    last = F.max("bucket").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    return span.join(ends, "bin", "left").select("bin", last.alias("last"))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = K, bucket_rows: int = BUCKET_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` (vec_id, embedding) of highest score for each of `queries`.

    The score is the integer inner product of floor(1024 x); ties go to the smaller vec_id; a query's own vec_id does
    not count. Vectors that are null or hold null or non-finite components, and null ids, take no part. Vectors of
    different widths do not meet. Rows that repeat a vec_id are candidates each; as queries the smallest vector counts.
    With fewer candidates all come back. Scores must fit 64 bits. Other columns are left out.
    """
    spark = vectors.sparkSession
    n = partitions(spark)

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long"), scaled(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
        return df.withColumns({"floor": F.lit(float("-inf")), "last": F.lit(0)})

    rows = sound(vectors).withColumn("length", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    buckets = max(1, -(-size["n"] // bucket_rows))
    group = max(1, group_bytes // (8 * bucket_rows * max(1, size["width"] or 0)))
    tables = rows.repartitionByRange(buckets, F.desc("length"), "vec_id").drop("length").mapInArrow(_packs(0, bucket_rows), _PACK)
    tables = materialised(tables)
    asked = materialised(sound(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    own = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    reach = materialised(_reach(tables)) if buckets > 1 else None
    span = reach.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).first() if reach is not None else None

    def blocks(found: DataFrame | None) -> DataFrame:
        if found is None:
            now = asked.withColumns({"floor": F.lit(float("-inf")), "last": F.lit(buckets - 1)})
        else:
            floor = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k)
            now = asked.join(floor.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")
            # A bucket is needed if its largest length reaches floor / own; one bin of slack for the rounding of logarithms.
            least = _bin(F.col("floor") / own) - 1
            now = now.withColumn("bin", F.when(F.col("floor") > 0, F.greatest(least, F.lit(span["a"]))).otherwise(F.lit(span["a"])))
            now = now.where(F.col("bin") <= span["b"]).join(F.broadcast(reach), "bin").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        return now.select("vec_id", "v", "floor", F.col("last").cast("int").alias("last")).sortWithinPartitions(F.desc("last")).mapInArrow(_packs(1, QUERY_BLOCK), _PACK)

    low, high, found = 0, 1, None
    while low < buckets:
        met = _met(tables, blocks(found), low, min(high, buckets), group, n, k)
        found = _ranked(met if found is None else found.unionByName(met), k)
        low, high = high, high * (1 + WAVE)
        if low < buckets:
            found = materialised(found.select("query_id", "vec_id", "score"))
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(rows, rows.where(F.col("vec_id") % 100 == 0))
