"""Near-duplicate vectors by Euclidean p-stable hashing, then exact cosines.

Equal vectors of a label are one class, so that copies are never compared. A class is hashed in several tables: its
normalised vector is projected on normal random directions, shifted and quantised, and the numbers of one table
together are its bucket there. Classes that share a bucket are compared by exact cosines, in blocks: a bucket of more
than BLOCK classes is dealt in pairs of blocks to as many tasks, and no pair leaves a task. A task returns one row for
a class, with the number of links found and the least class that it reaches there. Two classes are counted where they
first share a bucket, as each row brings all its buckets along.

For the number of tables see plan(): both it and the projections of a bucket follow from the number of vectors of the
largest label, so that a bucket holds about OCCUPANCY unrelated vectors at any size, and a pair at the threshold is
found with probability RECALL; nearer pairs more often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.llm._cluster import attached, components, materialised
from quillbank.llm._vectors import matrices, sound

COSINE = 0.93
RECALL = 0.98
OCCUPANCY = 1024
BLOCK = 1024
STEP = 2.5  # of the quantised projections; unit vectors at the threshold are 0.37 apart, unrelated ones 1.41
SEED = 20240301


def collision(distance: float, step: float = STEP) -> float:
    """Probability that two vectors so far apart get the same number from one projection."""
    r = step / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, occupancy: int = OCCUPANCY) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors that are compared with each other."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    wide = max(1, math.ceil(math.log(max(1.0, n / occupancy)) / -math.log(far)))
    return wide, math.ceil(math.log(1 - recall) / math.log(1 - near**wide))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; scaled first, so that no square overflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _keys(wide: int, tables: int):
    """Adds to each row its 32-bit bucket in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(SEED).integers(1, 2**63, wide, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for at, rows in matrices(batch, "v"):
                width = rows.shape[1]
                if width not in families:
                    rng = np.random.default_rng([SEED, width])
                    families[width] = rng.standard_normal((width, tables * wide)), rng.uniform(0, STEP, tables * wide)
                directions, shift = families[width]
                steps = np.floor((unit(rows) @ directions + shift) / STEP).astype(np.int64).astype(np.uint64).reshape(len(rows), tables, wide)
                hashed = (steps * mix).sum(2, dtype=np.uint64)
                hashed = ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, tables * len(rows) + 1, tables), pa.int32()), pa.array(hashed.reshape(-1)))
                taken = [batch.column(c).take(pa.array(at)) for c in ("k1", "k2", "label", "v", "first", "n")]
                yield pa.RecordBatch.from_arrays([*taken, keys], ["k1", "k2", "label", "v", "first", "n", "keys"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b have so high a cosine; those within rounding of it are decided by the plain formula."""
    found = a @ b.T
    linked = found >= cosine
    for i, j in np.argwhere(np.abs(found - cosine) < 1e-12).tolist():
        x, y = raw_a[i], raw_b[j]
        linked[i, j] = float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= cosine
    return linked


def compare(keys: np.ndarray, table: int, rows: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each of the rows of one bucket, for pairs of a left with a right one, or all if they are the same.

    links: weights of those that it links with here and with which it shares no bucket of an earlier table; root: the
    least place among those that it reaches here.
    """
    same, normal = len(left) == len(right) and bool((left == right).all()), unit(rows)
    hits = np.zeros((len(left), len(right)), bool)
    links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for i in range(0, len(left), 256):
        some = left[i : i + 256]
        part = _linked(normal[some], normal[right], rows[some], rows[right], cosine)
        part &= some[:, None] != right[None]
        hits[i : i + 256] = part
        earlier = np.zeros(part.shape, bool)
        for t in range(table):
            earlier |= keys[some, t][:, None] == keys[right, t][None]
        part = (part & ~earlier).astype(np.float64)
        links[some] += (part @ weight[right]).astype(np.int64)
        if not same:
            links[right] += (weight[some] @ part).astype(np.int64)
    while True:
        least = np.where(hits, root[right][None], len(rows)).min(1, initial=len(rows))
        now = root.copy()
        np.minimum.at(now, left, least)
        np.minimum.at(now, right, np.where(hits, now[left][:, None], len(rows)).min(0, initial=len(rows)))
        now = now[now]
        if (now == root).all():
            return links, root
        root = now


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _compared(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        group = table.combine_chunks().to_batches()[0]
        node, weight, side = group.column("node").to_numpy(), group.column("n").to_numpy().astype(np.float64), group.column("block").to_numpy()
        (_, rows), (_, keys) = next(matrices(group, "v")), next(matrices(group, "keys"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        links, root = compare(keys, group.column("t")[0].as_py(), rows, weight, np.flatnonzero(side == low), np.flatnonzero(side == high), cosine)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        return pa.Table.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], schema=_FOUND)

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, occupancy: int = OCCUPANCY, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding, label).

    Two rows link if they have one label, which is not null, one width, and a cosine of at least `cosine` in double
    precision. Rows whose label or vector is null, and vectors that are zero, empty or hold null or non-finite
    components, link with nothing: n_links 0 and their own id. Rows that repeat a vec_id are vectors each, and count as
    each other's links. Rows of null id take part; a component's id is its smallest id that is not null. kept says
    whether vec_id = component_id, nulls being equal. An empty table gives no rows. Other columns are left out.
    """
    live = F.col("label").isNotNull() & sound(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    # Adding zero makes -0 and 0 one value.
    v = F.when(live, F.transform("embedding", lambda x: x + F.lit(0).cast("float")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("v"))
    keyed = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(1), "label"))})
    most = vectors.where("label is not null").groupBy("label").count().agg(F.max("count").alias("n")).first()["n"]
    wide, tables = plan(most or 1, cosine, recall, occupancy)

    classes = keyed.where("v is not null").groupBy("k1", "k2", "label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    shape = f"k1 long, k2 long, label string, v {classes.schema['v'].dataType.simpleString()}, first long, n long, keys array<int>"
    classes = materialised(classes.mapInArrow(_keys(wide, tables), shape).withColumn("node", F.monotonically_increasing_id()))

    bucket = ["label", "size", "t", "key"]
    dealt = classes.select("node", "label", F.size("v").alias("size"), F.posexplode("keys").alias("t", "key"))
    counts = dealt.groupBy(*bucket).agg(F.count("*").alias("members")).where("members > 1")
    counts = counts.select(F.struct(*bucket).alias("bucket"), F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    dealt = classes.select("node", "label", "v", "n", "keys", F.size("v").alias("size"), F.posexplode("keys").alias("t", "key"))
    dealt = attached(dealt.withColumn("bucket", F.struct(*bucket)), materialised(counts), "bucket")
    # A row goes to each pair of blocks that its own is in.
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    found = dealt.select("bucket", "low", "high", "t", "block", "node", "n", "v", "keys").groupBy("bucket", "low", "high").applyInArrow(_compared(cosine), "node long, links long, root long")
    found = materialised(found)

    reached = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "k1", "k2", "first", "n").join(links, "node", "left").join(reached.withColumnRenamed("id", "node"), "node", "left")
    named = materialised(named.withColumn("root", F.coalesce("root", "node")))
    names = named.groupBy("root").agg(F.min("first").alias("component"))
    # Classes of one row without links need not be told apart from those without a class.
    named = named.join(names, "root").where("n > 1 or links is not null").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    out = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs; the same rows as long as hashing finds all links, as it does on the test tables.
OP12_SQL = """
WITH RECURSIVE kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM kept a JOIN kept b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), least AS (
  SELECT a, min(b) AS b FROM reached GROUP BY a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""
