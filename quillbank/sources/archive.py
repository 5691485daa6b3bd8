"""Backups: folders of Parquet tables with a manifest of counts and digests, written aside, verified, then put in place."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, VERSION = "manifest.json", 1


class ArchiveError(ValueError):
    """The folder is not a backup, or not what its manifest says."""


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table: sums of row hashes, whatever the order of rows or partitions."""
    rows = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    high, low = F.conv(F.substring(F.sha2(rows, 256), 1, 15), 16, 10).cast("decimal(38,0)"), F.xxhash64(rows).cast("decimal(38,0)")
    n, a, b = df.agg(F.count("*"), F.sum(high), F.sum(low)).first()
    return n, f"{a or 0:f}.{b or 0:f}"


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _manifest(spark: SparkSession, folder: str) -> dict:
    try:
        found = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", "true").text(f"{folder}/{MANIFEST}").collect()))
    except Exception as e:
        raise ArchiveError("no manifest") from e
    if not isinstance(found, dict) or found.get("version") != VERSION or not isinstance(found.get("tables"), dict):
        raise ArchiveError("unknown manifest")
    return found


def create(spark: SparkSession, tables: dict[str, DataFrame], folder: str, created_at_ms: int) -> dict:
    """Writes the tables as a backup at `folder`, which must not exist before or after; returns the manifest.

    What was written is read back and compared before it is put in place.
    """
    store, target = _store(spark, folder)
    if store.exists(target):
        raise FileExistsError(folder)
    aside = f"{folder.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{aside}/{name}")
        found = {name: dict(zip(("rows", "digest"), digest(spark.read.parquet(f"{aside}/{name}")), strict=True)) for name in tables}
        manifest = {"version": VERSION, "created_at_ms": created_at_ms, "tables": found}
        out = store.create(spark._jvm.org.apache.hadoop.fs.Path(f"{aside}/{MANIFEST}"), False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        inspect(spark, aside)
        if store.exists(target):
            raise FileExistsError(folder)
        if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target):
            raise ArchiveError("the backup could not be put in place")
    finally:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    return manifest


def inspect(spark: SparkSession, folder: str) -> dict:
    """The manifest, once every table has the rows and digest that it says."""
    manifest = _manifest(spark, folder)
    for name, said in manifest["tables"].items():
        try:
            got = digest(spark.read.parquet(f"{folder}/{name}"))
        except Exception as e:
            raise ArchiveError(f"table {name} cannot be read") from e
        if got != (said["rows"], said["digest"]):
            raise ArchiveError(f"table {name} differs from the manifest")
    return manifest


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a verified backup."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in inspect(spark, folder)["tables"]}
