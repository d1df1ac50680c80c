"""Embedding columns as numpy matrices, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Whether a vector is not NULL and all its components are finite numbers."""
    return F.coalesce(F.col(col).isNotNull() & F.forall(
        F.col(col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column of numbers without NULLs as float64, ``dim``
    wide; shorter rows end in zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64)
    size = np.diff(np.asarray(col.offsets, np.int64))
    if (size == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (scaled by the largest component first, so that
    no square overflows); zero rows stay zero."""
    top = np.abs(x).max(1, initial=0.0)
    top[top == 0] = 1.0
    x = x / top[:, None]
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    norm[norm == 0] = 1.0
    return x / norm[:, None]


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
