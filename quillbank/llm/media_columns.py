"""Media columns: bytes kept as PNG images in a binary column, and perceptual hashes of them.

A payload is stored as an 8-bit greyscale image of WIDTH samples a row. Each row is filtered the way that leaves the
smallest differences; rows go through zlib into chunks with checksums. Reading tests the signature, the checksum of
every chunk and of the stream, and takes the filters back in numpy. The feature of an image is the sign pattern of the
low frequencies of its cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.llm import _text

WIDTH = 576
PAD = 255
CHUNK_BYTES = 1 << 16
SIDE = 32
LOW = 8
_TEXT_LIMIT = 4 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, multiple: int = WIDTH) -> bytes:
    """data and bytes 255 up to a positive multiple."""
    return data + bytes([PAD]) * (-len(data) % multiple if data else multiple)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A greyscale image of rows of `width` samples; the payload must be a positive multiple of that long."""
    if not payload or len(payload) % width:
        raise ValueError(f"a positive multiple of {width} bytes is needed, not {len(payload)}")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], up[1:] = rows[:, :-1], rows[:-1]
    kinds = np.stack([rows, rows - left, rows - up])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    best = cost.argmin(0)
    lines = np.concatenate([best[:, None].astype(np.uint8), kinds[best, np.arange(len(rows))]], 1)
    stream = zlib.compress(lines.tobytes(), 6)
    parts = [stream[i : i + CHUNK_BYTES] for i in range(0, len(stream), CHUNK_BYTES)]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + b"".join(_chunk(b"IDAT", x) for x in parts) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, lines: np.ndarray, unit: int = 1) -> np.ndarray:
    """Samples of filtered rows (n, bytes); `unit` bytes make a pixel."""
    out = np.zeros_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    y = 0
    while y < len(lines):
        kind, end = kinds[y], y + 1
        while end < len(lines) and kinds[end] == kind and kind in (0, 1, 2):
            end += 1
        part = lines[y:end]
        if kind == 0:
            out[y:end] = part
        elif kind == 1:
            for u in range(unit):
                out[y:end, u::unit] = np.cumsum(part[:, u::unit], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[y:end] = np.cumsum(part, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            row, up = out[y], above.astype(np.int64)
            for x in range(lines.shape[1]):
                a, b = (int(row[x - unit]) if x >= unit else 0), int(up[x])
                c = int(up[x - unit]) if x >= unit else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc_ = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc_ else b if pb <= pc_ else c
                row[x] = (int(part[0, x]) + guess) & 255
        else:
            raise ValueError(f"filter {kind} is not known")
        above = out[end - 1]
        y = end
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows of 8-bit greyscale samples; a damaged file raises ValueError."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, stream, shape, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace is read")
            shape = (height, width)
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if shape is None or not ended:
        raise ValueError("a chunk is missing")
    try:
        lines = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise ValueError(f"the stream is damaged: {e}") from e
    if len(lines) != shape[0] * (shape[1] + 1):
        raise ValueError("the stream has another size than the header says")
    lines = np.frombuffer(lines, np.uint8).reshape(shape[0], shape[1] + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def _reduced(image: np.ndarray, side: int) -> np.ndarray:
    """Means of side x side areas; few rows or columns are repeated first."""
    for axis in (0, 1):
        if image.shape[axis] < side:
            image = np.repeat(image, -(-side // image.shape[axis]), axis)
        cuts = np.arange(side) * image.shape[axis] // side
        size = np.diff(np.append(cuts, image.shape[axis]))
        image = np.add.reduceat(image, cuts, axis, dtype=np.float64) / (size[:, None] if axis == 0 else size)
    return image


_COSINE = np.cos(np.pi * (2 * np.arange(SIDE)[None] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the cosine transform are above their median."""
    low = _COSINE @ _reduced(image, SIDE) @ _COSINE.T
    flat = np.round(low.reshape(-1), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes()


_SHAPE = "doc_id long, n_bytes long, media binary"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _text.sub_batches(whole, "text", _TEXT_LIMIT):
            data, bounds = _text.raw(batch.column("text"))
            images = [encode_png(padded(data[lo:hi].tobytes())) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(images, pa.binary())], schema=_STORED)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 text of each row of `docs` (doc_id, text), padded and stored as PNG.

    A null text is empty; an empty one is one row of padding. Rows that repeat and null ids come back as they are.
    Columns other than doc_id and text are left out.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store, _SHAPE)


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"]
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            if media is None:
                rows.append((None,) * 6)
                continue
            image = decode_png(media)
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)


def image_features(stored: DataFrame) -> DataFrame:
    """What is read back from the images of `stored` (doc_id, n_bytes, media), and their cosine hash.

    A null image gives nulls; a damaged one fails the job, as nothing right can be said of it.
    """
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, _READ)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image, read back and hashed."""
    out = image_features(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.withColumn("feature", F.lower(F.hex("hash"))).drop("hash")
