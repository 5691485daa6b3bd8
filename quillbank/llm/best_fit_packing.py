"""Packing tokenised documents into as few sequences of bounded length as possible.

Documents are tokenised once; those longer than a sequence are cut. How many pieces there are of each length (at most
`capacity` numbers, whatever the corpus) is all that the driver needs: large-item matching works on these counts. Pieces
above one third of the capacity go at most two to a sequence, each with the largest partner that still fits; smaller
ones then go, longest first, into the sequences with the least room that still holds them. Sequences that are filled
alike are one run of consecutive numbers, so the plan is a short list of (length, ranks, sequences, offset). Executors
rank the pieces of each length and look their places up in it.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbank.llm import _text
from quillbank.llm._cluster import materialised

CAPACITY = 4096
END_ID = 1
_TEXT_LIMIT = 4 << 20
_WORDS_HELD = 1 << 19
_SHARD_ROWS = 200_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizer file `name` is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of words, which this vocabulary gives independently of each other.

    At most about _WORDS_HELD words are held between batches, those that came in most of them first.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int32)

    def shrink(self) -> None:
        """Forget words that came once, and then the least used, until half of the room is free."""
        keep = np.argsort(-self.uses, kind="stable")[: _WORDS_HELD // 2]
        keep = np.sort(keep[self.uses[keep] > 1])
        hashes = np.empty(len(self.at), np.uint64)
        hashes[self.at] = self.hashes
        sizes = np.diff(self.begin)[keep]
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = self.ids[np.arange(begin[-1]) + np.repeat(self.begin[:-1][keep] - begin[:-1], sizes)]
        self.begin, self.uses, hashes = begin, self.uses[keep] // 2 + 1, hashes[keep]
        self.at = np.argsort(hashes)
        self.hashes = hashes[self.at]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word its number among those held, of which the ids are ids[begin[number] : begin[number + 1]]."""
        hashes = _text.word_hashes(data, starts, ends)
        unique, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.begin) > _WORDS_HELD:
            self.shrink()
        place = np.searchsorted(self.hashes, unique)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == unique[known]
        new = np.flatnonzero(~known)
        if len(new):
            words = [data[starts[i] : ends[i]].tobytes().decode() for i in example[new].tolist()]
            found: list[list[int]] = []
            for at in range(0, len(words), 8192):
                found += [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + 8192], add_special_tokens=False)]
            sizes = np.cumsum([len(x) for x in found]) + self.begin[-1]
            number = np.arange(len(new)) + len(self.begin) - 1
            self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
            self.begin = np.concatenate([self.begin, sizes])
            merged = np.concatenate([self.hashes, unique[new]])
            order = np.argsort(merged)
            self.hashes, self.at = merged[order], np.concatenate([self.at, number])[order]
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        numbers = self.at[np.searchsorted(self.hashes, unique)]
        self.uses[numbers] += 1
        return numbers[inverse]


@lru_cache(maxsize=1)
def held_words(path: str) -> WordIds:
    """The words that this Python worker holds, from one task to the next."""
    return WordIds(path)


def document_ids(held: WordIds, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all texts, one after the other, and the n + 1 bounds; a null text has none."""
    data, bounds = _text.raw(text)
    starts, ends, first = _text.spans(data, bounds)
    numbers = held.numbers(data, starts, ends)
    size = held.begin[numbers + 1] - held.begin[numbers]
    at = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(at[-1]) + np.repeat(held.begin[numbers] - at[:-1], size)
    return held.ids[source], at[first]


def _pieces(path: str, capacity: int, end_id: int):
    shape = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_words(path)
        for whole in batches:
            for batch in _text.sub_batches(whole, "text", _TEXT_LIMIT):
                ids, bounds = document_ids(held, batch.column("text"))
                rows = []
                for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    whole_ids = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, hi - lo + 1, capacity)):
                        part = whole_ids[4 * at : 4 * (at + capacity)]
                        rows.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return run


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """How to pack counts[length] pieces of each length: rows (length, rank, pieces, sequence, per_sequence, offset).

    The pieces ranked rank, ..., rank + pieces - 1 of that length go to the sequences from `sequence` on,
    per_sequence of them side by side in each, from `offset`.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    runs: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, sequences)
    rooms: list[int] = []

    def keep(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            heapq.heappush(runs[room], (first, many))

    def put(length: int, pieces: int, sequence: int, per: int, offset: int) -> None:
        plan.append((length, used[length], pieces, sequence, per, offset))
        used[length] += pieces
        left[length] -= pieces
        if not left[length]:
            del left[length]

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        top = large[-1]
        at = bisect_left(large, capacity - top + 1) - 1
        other = large[at] if at >= 0 else 0
        many = left[top]
        if other == top:
            pairs, odd = divmod(many, 2)
            if pairs:
                put(top, pairs, opened, 1, 0)
                put(top, pairs, opened, 1, top)
                keep(capacity - 2 * top, opened, pairs)
                opened += pairs
            if odd:
                at -= 1
                partner = large[at] if at >= 0 else 0
                put(top, 1, opened, 1, 0)
                if partner:
                    put(partner, 1, opened, 1, top)
                keep(capacity - top - partner, opened, 1)
                opened += 1
        else:
            many = min(many, left[other]) if other else many
            put(top, many, opened, 1, 0)
            if other:
                put(other, many, opened, 1, top)
            keep(capacity - top - other, opened, many)
            opened += many
        large = [n for n in large if n in left]

    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                full, rest = divmod(left[length], per)
                if full:
                    put(length, full * per, opened, per, 0)
                    keep(capacity - per * length, opened, full)
                    opened += full
                if rest:
                    put(length, rest, opened, rest, 0)
                    keep(capacity - rest * length, opened, 1)
                    opened += 1
                continue
            room = rooms[at]
            first, many = heapq.heappop(runs[room])
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            per = min(room // length, left[length])  # what fits once fits best again: the room only shrinks
            many_used = min(many, left[length] // per)
            put(length, many_used * per, first, per, capacity - room)
            keep(room - per * length, first, many_used)
            keep(room, first + many_used, many - many_used)
    return plan


_PLAN = "length long, rank long, pieces long, sequence long, per long, offset long"


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece of `docs` (doc_id, text).

    A null or empty text is the end id alone. Only documents longer than `capacity` are cut; their last piece may be
    shorter. Within a sequence offsets have no gaps. Rows that repeat a doc_id are packed each; a null doc_id stays
    null. An empty table gives no rows. Columns other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = materialised(docs.mapInArrow(_pieces(path or vocabulary_path(), capacity, end_id), shape))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)

    shards = max(1, -(-sum(counts.values()) // _SHARD_ROWS), len(counts) and 64)
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    sizes = sharded.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sharded.withColumn("place", F.row_number().over(inside) - 1).join(sizes, ["length", "shard"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _placed(plan: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = int(table[:, 1].max()) + 1 if len(table) else 1
        keys = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, length * stride + np.minimum(rank, stride - 1), "right") - 1]
            place = rank - row[:, 1]
            sequence, offset = row[:, 3] + place // row[:, 4], row[:, 5] + place % row[:, 4] * length
            arrays = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes."""
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
