"""Where intermediate tables are kept, and connected components over them."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share: spark.checkpoint.dir, or the context's.

    A temporary folder of this machine stands in where neither is set and the master is local, as in tests; on a
    cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillbank-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder, so that a lost executor costs no more than a reread."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of tables that are no longer referred to.

    It does so once the driver's JVM has collected what stood for them, which may be long after when that has much memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


SMALL_TABLE = 100_000
_EDGES_A_TASK = 100_000


def attached(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """df inner join small (materialised, one short row for each key): by broadcast if it has at most SMALL_TABLE rows."""
    return df.join(F.broadcast(small) if small.count() <= SMALL_TABLE else small, key)


MARK_BITS = 27


def marked_by(df: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """`df` with a column that is true where `ids` (one column) has the key, and for few other keys too.

    The keys are 64-bit hashes. They go to all tasks as a bitmap of their upper bits, 16 bits for each of `ids` as long as
    those are not more than 2 ** MARK_BITS.
    """
    bits = min(MARK_BITS, max(15, (16 * ids.count()).bit_length()))
    place = lambda c: F.shiftrightunsigned(c, 64 - bits) + 1
    found = ids.select(place(ids.columns[0]).alias("__at")).groupBy(F.bitmap_bucket_number("__at").alias("__bucket"))
    found = materialised(found.agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__bits")))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1, F.lit(False))
    return df.withColumn("__bucket", F.bitmap_bucket_number(place(key))).join(F.broadcast(found), "__bucket", "left").withColumn(name, has).drop("__bucket", "__bits")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each vertex of the undirected edges (a, b): root is the smallest id of its connected component.

    Large-star and small-star rounds: each shuffles the edges only, pre-aggregates the minimum of a vertex before
    the shuffle and ends with a star around every root. Null ends are ignored. The number of tasks follows the
    number of edges.
    """
    n = partitions(edges.sparkSession)
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = materialised(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(edges)
    while before[0]:
        tasks = min(n, 1 + before[0] // _EDGES_A_TASK)
        edges = edges.coalesce(tasks)
        both = edges.select("a", "b", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialised(small.union(low).coalesce(tasks).distinct().coalesce(tasks))
        after = _digest(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
