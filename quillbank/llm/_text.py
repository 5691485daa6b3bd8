"""Words and rolling hashes of many texts at once, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D, which in UTF-8 is the pattern [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEGMENT = 1 << 17
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BP, _WP = _powers(_BYTE_BASE, _SEGMENT + 64), _powers(_WORD_BASE, _SEGMENT + 64)
_BI, _WI = _powers(pow(_BYTE_BASE, -1, 2**64), _SEGMENT + 64), _powers(pow(_WORD_BASE, -1, 2**64), _SEGMENT + 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of slices of rows that have at most `limit` bytes together, or of one row if that has more."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def sub_batches(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes of text each, or of one row if that is longer."""
    for lo, hi in slices(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(False)).astype(np.int64), limit):
        yield batch.slice(lo, hi - lo)


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and the n + 1 bounds; a null is empty."""
    text = text.cast(pa.large_string()).fill_null("")
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n + 1 values)."""
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    if len(data):
        before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        if ends[j - 1] - base > _SEGMENT:
            total, scale = 0, 1
            for at in range(base, ends[i], _SEGMENT):
                piece = data[at : min(at + _SEGMENT, ends[i])]
                total += scale * int(np.sum(_BYTE_VALUE[piece] * _BP[: len(piece)], dtype=np.uint64))
                scale = scale * pow(_BYTE_BASE, _SEGMENT, 2**64) % 2**64
            out[i] = total % 2**64
        else:
            piece = data[base : ends[j - 1]]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[piece] * _BP[: len(piece)], out=sums[1:])
            first = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[first]) * _BI[first]
        i = j
    return mixed(out ^ mixed((ends - starts).astype(np.uint64)))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every `width` consecutive words, across text bounds too."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, _SEGMENT):
        j = min(n, i + _SEGMENT)
        piece = words[i : j + width - 1]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _WP[: len(piece)], out=sums[1:])
        out[i:j] = (sums[width:] - sums[:-width]) * _WI[: j - i]
    return mixed(out)


def windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index and start word of every window that lies in one text."""
    hashes = window_hashes(words, width)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(hashes)]
    at = np.flatnonzero(np.arange(len(hashes)) + width <= first[1:][text])
    return hashes[at], text[at], at


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of equal ranges of the hash space; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def packed_bytes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked_bytes(data: bytes, width: int) -> np.ndarray:
    """What packed_bytes() was given, with zeros above."""
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[bytes, list[int]]:
    """The words of each text joined by one space, one text after the other, and the n + 1 bounds."""
    if not len(starts):
        return b"", [0] * len(first)
    size = ends - starts + 1
    at = np.cumsum(size)
    source = np.arange(at[-1]) + np.repeat(starts - (at - size), size)
    out = np.append(data, np.uint8(32))[source]
    out[at - 1] = 32
    bounds = np.concatenate([[0], at])[first]
    texts = np.diff(first) > 0
    last = at[first[1:][texts] - 1] - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    return out[keep].tobytes(), (bounds - np.concatenate([[0], np.cumsum(texts)])).tolist()
