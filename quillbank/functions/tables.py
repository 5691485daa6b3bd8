"""Intermediate tables and distributed row numbers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master a temporary one will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillbank-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with the number of each row, from 0, in a total order; without gathering all rows in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialised(placed)
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(before)]
        before += sizes[p]
    start = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return placed.withColumn(name, (inside + start).cast("long")).drop("__at")
