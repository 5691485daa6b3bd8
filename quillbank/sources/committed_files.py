"""A sink for files that are rows: tasks write them aside, one commit puts them all in place, or none.

    spark.dataSource.register(CommittedFiles)
    files.write.format("committed_files").mode("append").option("path", folder).save()

files has (name string, content binary). Each task attempt writes into a folder of its own below a folder beside the
target, and reports names, sizes and digests. The commit takes the files of the attempts that count, adds a manifest
and renames the folder to the target, which must exist neither before the job nor then. What failed or repeated
attempts have written goes with the folder, and so does all of it if the job is aborted; an attempt that still runs then
finds no folder to write to. Stores are those of
pyarrow.fs; a rename there has to be one step, as in local and Hadoop file systems.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, MANIFEST, VERSION = "committed_files", "manifest.json", 1


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path there."""
    path = path.rstrip("/")
    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path.removeprefix('file:')}"
    return fs.FileSystem.from_uri(path)


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def _discard(store: fs.FileSystem, path: str) -> None:
    """Removes a folder that tasks may still write to: under another name, which none of them knows."""
    store.move(path, f"{path}.gone")
    store.delete_dir(f"{path}.gone")


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt has written: its folder, and (name, bytes, sha256) of each file."""

    attempt: str
    files: list[tuple[str, int, str]]


class FilesWriter(DataSourceArrowWriter):
    """Writes rows (name, content) as files; see the module."""

    def __init__(self, folder: str, allow_none: bool) -> None:
        self.folder, self.allow_none = folder, allow_none
        store, target = _place(folder)
        if _exists(store, target):
            raise FileExistsError(f"{folder} exists already")
        self.aside = f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.{uuid.uuid4().hex}.part"
        store.create_dir(self.aside, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, _ = _place(self.folder)
        attempt, files = uuid.uuid4().hex, []
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or name[0] in "._" or "/" in name or name == MANIFEST:
                    raise ValueError(f"no name for a file: {name!r}")
                if not files:
                    store.create_dir(f"{self.aside}/{attempt}", recursive=False)  # fails once the job is aborted
                content = content or b""
                with store.open_output_stream(f"{self.aside}/{attempt}/{name}") as out:
                    out.write(content)
                files.append((name, len(content), hashlib.sha256(content).hexdigest()))
        return Written(attempt, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, target = _place(self.folder)
        done = [m for m in messages if m is not None]
        files = sorted(f for m in done for f in m.files)
        twice = sorted(n for n, k in Counter(f[0] for f in files).items() if k > 1)
        if twice:
            raise ValueError(f"names that came twice: {twice[:5]}")
        if not files and not self.allow_none:
            raise ValueError("there is nothing to write")
        whole = f"{self.aside}/whole"
        store.create_dir(whole, recursive=True)
        for m in done:
            for name, _, _ in m.files:
                store.move(f"{self.aside}/{m.attempt}/{name}", f"{whole}/{name}")
        manifest = {"version": VERSION, "files": [{"name": n, "bytes": b, "sha256": s} for n, b, s in files]}
        with store.open_output_stream(f"{whole}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        if _exists(store, target):
            raise FileExistsError(f"{self.folder} exists already")
        store.move(whole, target)
        _discard(store, self.aside)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _place(self.folder)
        if _exists(store, self.aside):
            _discard(store, self.aside)


class CommittedFiles(DataSource):
    """The format "committed_files"; options: path, and allow_none to accept a job without rows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are never overwritten")
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows of name and content are needed")
        return FilesWriter(self.options["path"], self.options.get("allow_none", "false") == "true")


def save_files(files: DataFrame, folder: str, allow_none: bool = False) -> None:
    """Writes rows (name, content) as files of a new folder, all or none."""
    spark = files.sparkSession
    if _exists(*_place(folder)):
        raise FileExistsError(f"{folder} exists already")
    spark.dataSource.register(CommittedFiles)
    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    rows.write.format(FORMAT).mode("append").option("path", folder).option("allow_none", str(allow_none).lower()).save()


def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the files of a folder, as its manifest has them."""
    shape = "version int, files array<struct<name string, bytes long, sha256 string>>"
    text = spark.read.option("wholetext", "true").text(f"{folder.rstrip('/')}/{MANIFEST}").select(F.from_json("value", shape).alias("m"))
    return text.select(F.explode("m.files").alias("f")).select("f.*")


def file_faults(spark: SparkSession, folder: str) -> DataFrame:
    """(name, fault) of the files of a folder that are not as its manifest says: missing, changed, not listed."""
    found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    both = file_list(spark, folder).join(found.where(F.col("name") != MANIFEST), "name", "full_outer")
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("name", fault.alias("fault")).where("fault is not null")
