"""Quality classifier: a small convolutional network over the bytes of whole documents, in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run over each chunk; the
largest response of each filter in a chunk, then the largest and the mean of those over all chunks, are combined into
one probability. Bytes are embedded by a learned table. Training is on a bounded sample of labelled rows (whole texts),
on the driver; the weights are a few kilobytes and go to the executors with the function that scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbank.llm import _text

CHUNK = 256
OVERLAP = 8
WIDTH = 8
STRIDE = 2
EMBEDDING = 6
FILTERS = 24
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 12 << 20
EPOCHS = 8
SEED = 5
THRESHOLD = 0.3
_TEXT_LIMIT = 2 << 20
_NEW = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


@dataclass
class Network:
    """Byte table, filters with bias, and the weights and bias of the pooled responses."""

    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float


def chunk_positions(size: int) -> np.ndarray:
    """Starts of the chunks (CHUNK bytes, each OVERLAP into the next) that cover `size` bytes; one at least."""
    return np.arange(0, max(1, size - OVERLAP), CHUNK - OVERLAP)


def _chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts as rows of byte values (256 where a text has ended), and where each text's begin."""
    sizes = np.diff(bounds)
    starts = [chunk_positions(int(n)) for n in sizes]
    first = np.concatenate([[0], np.cumsum([len(x) for x in starts])])
    inside = np.concatenate(starts) if len(starts) else np.zeros(0, int)
    text = np.repeat(np.arange(len(sizes)), np.diff(first))
    at = inside[:, None] + np.arange(CHUNK)[None]
    out = np.full(at.shape, 256, np.int16)
    ok = at < sizes[text][:, None]
    out[ok] = data[(at + bounds[:-1][text][:, None])[ok]]
    return out, first


def _forward(net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk, where it is, and the windows of embedded bytes."""
    places = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
    shown = net.table[rows].reshape(len(rows), CHUNK * EMBEDDING)
    view = np.lib.stride_tricks.sliding_window_view(shown, WIDTH * EMBEDDING, axis=1)[:, :: STRIDE * EMBEDDING]
    flat = np.ascontiguousarray(view).reshape(-1, WIDTH * EMBEDDING)
    response = (flat @ net.filters).reshape(len(rows), len(places), FILTERS)
    best = response.argmax(1)
    top = np.take_along_axis(response, best[:, None], 1)[:, 0] + net.bias
    return np.maximum(top, 0), best, flat.reshape(len(rows), len(places), -1)


def _pooled(top: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the largest and the mean of its chunks' responses."""
    most = np.maximum.reduceat(top, first[:-1], axis=0)
    mean = np.add.reduceat(top, first[:-1], axis=0) / np.diff(first)[:, None]
    return np.concatenate([most, mean], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted to whole texts by Adam on the logistic loss, in a fixed order of a fixed seed.

    Both labels weigh the same in all. Without labels of both kinds every score is the share of label 1, or a half.
    """
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32),
        rng.normal(0, (WIDTH * EMBEDDING) ** -0.5, (WIDTH * EMBEDDING, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    net.table[256] = 0
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.weights[:] = 0
        share = float(y.mean()) if len(y) else 0.5
        net.offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    cost = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    held = [np.zeros_like(x) for x in (net.table, net.filters, net.bias, net.weights, np.zeros(1, np.float32))]
    square = [np.zeros_like(x) for x in held]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            data, bounds = _text.raw(pa.array([texts[i] for i in pick], pa.string()))
            rows, first = _chunks(data, bounds)
            top, best, flat = _forward(net, rows)
            pooled = _pooled(top, first)
            error = (_sigmoid(pooled @ net.weights + net.offset) - y[pick]) * cost[pick] / len(pick)
            d_pooled = error[:, None] * net.weights[None]
            owner = np.repeat(np.arange(len(pick)), np.diff(first))
            d_top = d_pooled[owner, FILTERS:] / np.diff(first)[owner, None]
            d_top += d_pooled[owner, :FILTERS] * (top == pooled[owner, :FILTERS])
            d_top *= top > 0
            chunk, kind = np.nonzero(d_top)
            shown, push = flat[chunk, best[chunk, kind]], d_top[chunk, kind][:, None].astype(np.float32)
            g_filters = np.zeros_like(net.filters.T)
            np.add.at(g_filters, kind, shown * push)
            g_table = np.zeros_like(net.table)
            seen = rows[chunk[:, None], best[chunk, kind][:, None] * STRIDE + np.arange(WIDTH)[None]]
            np.add.at(g_table, seen, (net.filters.T[kind] * push).reshape(-1, WIDTH, EMBEDDING))
            g_table[256] = 0
            gradients = [g_table, g_filters.T, d_top.sum(0), pooled.T @ error + 1e-4 * net.weights, np.array([error.sum()])]
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, g in enumerate(gradients):
                held[k] += 0.1 * (g.astype(np.float32) - held[k])
                square[k] += 0.01 * (g.astype(np.float32) ** 2 - square[k])
                move = rate * (held[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)
                if k == 4:
                    net.offset -= float(move[0])
                else:
                    (net.table, net.filters, net.bias, net.weights)[k][...] -= move.astype(np.float32)
    return net


def scores(net: Network, data: np.ndarray, bounds: np.ndarray, rows_at_once: int = 2048) -> np.ndarray:
    """Probability of label 1 of each text."""
    sizes = np.diff(bounds)
    counts = np.array([len(chunk_positions(int(n))) for n in sizes])
    out, at = np.empty(len(sizes)), 0
    ends = np.cumsum(counts)
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + rows_at_once, "right")))
        if counts[at] > rows_at_once:  # a very long text: its chunks in parts
            most, total, done = np.zeros(FILTERS), np.zeros(FILTERS), 0
            span = rows_at_once * (CHUNK - OVERLAP)
            begin, size = int(bounds[at]), int(sizes[at])
            for s in range(0, max(1, size - OVERLAP), span):
                part = data[begin + s : begin + min(size, s + span + OVERLAP)]
                top, _, _ = _forward(net, _chunks(part, np.array([0, len(part)]))[0])
                most, total, done = np.maximum(most, top.max(0)), total + top.sum(0), done + len(top)
            pooled = np.concatenate([most, total / done])[None]
            to = at + 1
        else:
            rows, first = _chunks(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            pooled = _pooled(_forward(net, rows)[0], first)
        out[at:to] = _sigmoid(pooled @ net.weights + net.offset)
        at = to
    return out


def held_out(doc_id):
    """Whether labels of this doc_id are kept from training: crc32 of it as text, mod 5, is 0."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Train on labelled rows that are not held out: the `sample_rows` of each label with the smallest seeded hash.

    Of those, texts are taken until `sample_bytes` are reached, so the driver holds a bounded sample. Null labels and
    null ids do not count; of several labels of one doc_id the smallest counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id")))
    ranked = known.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
    picked = [ranked.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample_rows) for y in (0, 1)]
    sample = picked[0].union(picked[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.select("h", "y", "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    texts, ys, size = [], [], 0
    for r in rows.orderBy("h", "doc_id", "text").limit(4 * sample_rows).toLocalIterator():
        if size + r["n"] > sample_bytes:
            continue
        size += r["n"]
        texts.append(r["text"])
        ys.append(r["y"])
    return train(texts, ys)


def _score(net: Network, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _text.sub_batches(whole, "text", _TEXT_LIMIT):
                out = scores(net, *_text.raw(batch.column("text")))
                ids = batch.column("doc_id").to_pylist()
                fold = pa.array([None if x is None else zlib.crc32(str(x).encode()) % 5 == 0 for x in ids], pa.bool_())
                kept = [batch.column(i) for i in range(batch.num_columns)]
                names = [*batch.schema.names, "held_out", "score", "predicted"]
                yield pa.RecordBatch.from_arrays([*kept, fold, pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=names)

    return run


def score_quality(docs: DataFrame, net: Network, threshold: float = THRESHOLD, with_columns: bool = False) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of `docs`, or all its columns and these, if asked for.

    Columns of `docs` that are called held_out, score or predicted give way to the new ones.

    Empty and null texts get the score of an empty text. held_out is null where doc_id is. Rows that repeat come back
    each. Only the bytes of the text are input.
    """
    rows = docs.drop("held_out", "score", "predicted") if with_columns else docs.select("doc_id", "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    out = rows.mapInArrow(_score(net, threshold), T.StructType([*rows.schema.fields, *_NEW]))
    return out if with_columns else out.drop("text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, by a network fitted to the labels of the other folds."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return score_quality(docs, fit(docs, labels))
