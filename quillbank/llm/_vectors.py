"""Vectors of Arrow batches as matrices, and which of them count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~broken


def floored(vector: Column, scale: int) -> Column:
    """floor(scale x) of each component, as double; null for a vector that is not sound."""
    return F.when(sound(vector), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each width among the vectors of a list column without nulls."""
    lists = batch.column(column)
    begin, values = lists.offsets.to_numpy(), lists.values.to_numpy(False)
    widths = np.diff(begin)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        yield at, values[begin[at][:, None] + np.arange(width)[None]].astype(np.float64, copy=False)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a with rows of b; by floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
