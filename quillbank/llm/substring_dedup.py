"""Substring deduplication: passages that an earlier document already has are cut out.

Every window of `width` words gets a Rabin-Karp hash. A map task keeps, for each hash, the smallest doc_id it has
seen in some megabytes of text (so one entry for each window of these goes on, however often a passage occurs), packs the rest as 8 bytes a
window for a range of the hash space, and Spark deals those ranges to reducers, which find the smallest doc_id of
each. A window of any other document is repeated; repeated windows merge into maximal intervals, and those words go.
Texts meet the keys of their repeated windows in a join by doc_id, for which they are compressed one by one.

Two windows are one if 56 bits and the range of one hash and 8 bits of a second, independent one are the same: 72 bits
from 64 shuffle partitions on, 77 from 2048 on. Of n windows about n * n / 2**73 (2**78) pairs are wrongly taken for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbank.llm import _text
from quillbank.llm._cluster import partitions

WIDTH = 13
_KEPT_BYTES = 7
_CHECK_BYTES = 1
_SECOND = np.uint64(0x6A09E667F3BCC909)
_TEXT_LIMIT = 4 << 20
_NEW = [T.StructField(x, k) for x, k in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))]


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    low = hashes & np.uint64(2 ** (8 * _KEPT_BYTES) - 1)
    return low | (_text.bucket_of(hashes, buckets) << np.uint64(8 * _KEPT_BYTES))


def _checks(words: np.ndarray, width: int) -> np.ndarray:
    """A second hash of every window, of which _CHECK_BYTES are used."""
    return _text.window_hashes(_text.mixed(words ^ _SECOND), width) & np.uint64(2 ** (8 * _CHECK_BYTES) - 1)


def _ordered(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows are neighbours, and where in it each begins."""
    order = np.argsort(keys)
    a, b = keys[order], checks[order]
    new, differ = a[1:] != a[:-1], b[1:] != b[:-1]
    if np.any(differ & ~new):  # one key, several windows
        order = np.lexsort((checks, keys))
        a, b = keys[order], checks[order]
        new, differ = a[1:] != a[:-1], b[1:] != b[:-1]
    return order, np.flatnonzero(np.concatenate([[True], new | differ]))


def _grouped(keys: np.ndarray, checks: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the smallest owner of its window, and whether it is the first entry of that owner and window."""
    least, first = np.empty_like(owners), np.zeros(len(keys), bool)
    if len(keys) == 0:
        return least, first
    order, heads = _ordered(keys, checks)
    sizes = np.diff(np.concatenate([heads, [len(keys)]]))
    lows = np.minimum.reduceat(owners[order], heads)
    least[order] = np.repeat(lows, sizes)
    at = np.flatnonzero(owners[order] == np.repeat(lows, sizes))
    group = np.repeat(np.arange(len(heads)), sizes)[at]
    first[order[at[np.concatenate([[True], group[1:] != group[:-1]])]]] = True
    return least, first


def _by_owner(owners: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(owner, its keys), each key once."""
    if not len(owners):
        return
    order = np.argsort(owners, kind="stable")
    owners, keys = owners[order], keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    for lo, hi in zip(cuts, [*cuts[1:], len(owners)], strict=True):
        yield int(owners[lo]), np.unique(keys[lo:hi]).tobytes()


_SHAPE = "bucket int, doc_id long, keys binary, checks binary, owners binary, counts binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _scan(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _text.sub_batches(whole.filter(pc.is_valid(whole.column("doc_id"))), "text", _TEXT_LIMIT):
                ids = batch.column("doc_id").to_numpy(False)
                data, bounds = _text.raw(batch.column("text"))
                starts, ends, first = _text.spans(data, bounds)
                words = _text.word_hashes(data, starts, ends)
                hashes, text, place = _text.windows(words, first, width)
                if not len(hashes):
                    continue
                keys, checks, owners = _keys(hashes, buckets), _checks(words, width)[place], ids[text]
                least, head = _grouped(keys, checks, owners)
                later = owners > least
                rows = [(doc % buckets, doc, packed, None, None, None) for doc, packed in _by_owner(owners[later], keys[later])]
                keys, checks, owners, bucket = keys[head], checks[head], text[head], _text.bucket_of(hashes[head], buckets)
                order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
                keys, checks, owners, bucket = keys[order], checks[order], owners[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                for lo, hi in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                    turn = np.flatnonzero(np.concatenate([[True], owners[lo + 1 : hi] != owners[lo : hi - 1]]))
                    counts = np.diff(np.concatenate([turn, [hi - lo]])).astype("<u4")
                    packed = _text.packed_bytes(keys[lo:hi], _KEPT_BYTES), _text.packed_bytes(checks[lo:hi], _CHECK_BYTES)
                    rows.append((int(bucket[lo]), None, *packed, ids[owners[lo:hi][turn]].astype("<i8").tobytes(), counts.tobytes()))
                for at in range(0, len(rows), 4096):
                    yield _batch(rows[at : at + 4096])

    return run


_MARK = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def marks(owners: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(keys.view(np.int64))], schema=_MARK)

    def solved(bucket: int, parts: list[tuple[bytes, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([_text.unpacked_bytes(k, _KEPT_BYTES) for k, _, _, _ in parts])
        checks = np.concatenate([_text.unpacked_bytes(x, _CHECK_BYTES) for _, x, _, _ in parts])
        owners = np.concatenate([np.repeat(np.frombuffer(o, "<i8"), np.frombuffer(c, "<u4")) for _, _, o, c in parts])
        keys = low | (np.uint64(bucket) << np.uint64(8 * _KEPT_BYTES))
        least, _ = _grouped(keys, checks, owners)
        later = np.flatnonzero(owners > least)
        for at in range(0, len(later), 1 << 16):
            part = later[at : at + (1 << 16)]
            yield marks(owners[part], keys[part])

    bucket, parts = None, []
    for batch in batches:
        known = batch.filter(pc.is_valid(batch.column("doc_id")))
        if known.num_rows:
            keys = [np.frombuffer(x, np.uint64) for x in known.column("keys").to_pylist()]
            yield marks(np.repeat(known.column("doc_id").to_numpy(), [len(x) for x in keys]), np.concatenate(keys))
        batch = batch.filter(pc.is_null(batch.column("doc_id")))
        for b, *row in zip(*(batch.column(x).to_pylist() for x in ("bucket", "keys", "checks", "owners", "counts")), strict=True):
            if b != bucket and parts:
                yield from solved(bucket, parts)
                parts = []
            bucket = b
            parts.append(tuple(row))
    if parts:
        yield from solved(bucket, parts)


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, int]:
    """(doc_id, key): the key of each window of a document that also starts in one with a smaller doc_id.

    Also the number of hash ranges, which a later scan needs in order to form the same keys.
    """
    n = partitions(docs.sparkSession)
    buckets = min(4 * n, 1 << 20)
    found = docs.select("doc_id", "text").mapInArrow(_scan(width, buckets), _SHAPE)
    return found.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, "doc_id long, key long"), buckets


def covered(length: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of `length` words lie in a window that starts at one of `starts`: the union of maximal intervals."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames, which say how long the text is; nulls stay."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for whole in batches:
        for batch in _text.sub_batches(whole, "text", _TEXT_LIMIT):
            frames = [None if x is None else pack(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(frames, pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _pack() was given, in batches of at most _TEXT_LIMIT bytes of text, or of one row if that is longer."""
    unpack = zstandard.ZstdDecompressor().decompress
    for whole in batches:
        frames = whole.column("text").to_pylist()
        sizes = np.array([0 if x is None else zstandard.frame_content_size(x) for x in frames], np.int64)
        for lo, hi in _text.slices(sizes, _TEXT_LIMIT):
            texts = [None if x is None else unpack(x) for x in frames[lo:hi]]
            yield whole.slice(lo, hi - lo).set_column(whole.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))


def _cut(width: int, buckets: int, with_text: bool, packed: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = _unpacked(batches) if packed else (b for whole in batches for b in _text.sub_batches(whole, "text", _TEXT_LIMIT))
        for batch in plain:
            data, bounds = _text.raw(batch.column("text"))
            starts, ends, first = _text.spans(data, bounds)
            flags = batch.column("marks")
            mark, known_keys = flags.offsets.to_numpy(), flags.values.to_numpy().view(np.uint64)
            keep = np.ones(len(starts), bool)
            some = np.flatnonzero((np.diff(mark) > 0) & (np.diff(first) >= width)).tolist()
            words = _text.word_hashes(data, starts, ends) if some else None
            for i in some:
                lo, hi = int(first[i]), int(first[i + 1])
                keys = _keys(_text.window_hashes(words[lo:hi], width), buckets)
                known = np.sort(known_keys[mark[i] : mark[i + 1]])  # of one document, so that 64 bits are enough
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                keep[lo:hi] = ~covered(hi - lo, np.flatnonzero(known[at] == keys), width)
            at = np.flatnonzero(keep)
            left = np.searchsorted(at, first)
            kept, cuts = _text.joined(data, starts[at], ends[at], left)
            texts = [kept[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            total = np.diff(first)
            names = [f.name for f in batch.schema if f.name != "marks" and (with_text or f.name != "text")]
            arrays = [batch.column(x) for x in names] + [pa.array(total, pa.int64()), pa.array(total - np.diff(left), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            if with_text:
                arrays.append(pa.array([x.decode() for x in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, with_columns: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of `docs` (doc_id, text).

    If asked for, all columns of `docs` come too, and kept_text; columns with the names of new ones give way to them,
    as does one called marks.

    Each word covered by a window that also starts in a document with a smaller doc_id goes. Windows are judged on the
    input. The kept words are joined by one space. Null texts count as empty (no words, the digest of no bytes). A row
    whose doc_id is null neither removes nor loses words, and takes no part in the join. Rows that repeat a doc_id are one document as to "smaller",
    so copies under the same id do not remove each other.
    """
    marks, buckets = repeated_windows(docs, width)
    marks = marks.groupBy("doc_id").agg(F.collect_list("key").alias("marks"))
    rows = docs.drop(*(f.name for f in _NEW), "marks") if with_columns else docs.select("doc_id", "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    packed = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType, True) for f in rows.schema.fields])
    known, unknown = rows.where("doc_id is not null"), rows.where("doc_id is null")
    joined = known.mapInArrow(_pack, packed).join(marks, "doc_id", "left")
    alone = unknown.withColumn("marks", F.lit(None).cast("array<long>")).select(*joined.columns)
    fields = [rows.schema[c] for c in joined.columns if c != "marks" and (with_columns or c != "text")]
    shape = T.StructType([*fields, *_NEW[: 3 + with_columns]])
    return joined.mapInArrow(_cut(width, buckets, with_columns), shape).unionByName(alone.mapInArrow(_cut(width, buckets, with_columns, False), shape))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, n_removed and the digest of what is kept, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return substring_dedup(docs)
