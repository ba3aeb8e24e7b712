"""Integer vectors: components scaled and rounded down, so that sums, distances and inner products are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a scaled component at most, sign apart: squared distances and inner products of up to 256 components fit a long.
MOST_BITS = 27


def usable(vector: str, scale: int) -> Column:
    """Whether every component is there, finite and, once scaled, within ``MOST_BITS`` bits."""
    most = float(2**MOST_BITS / scale)
    fits = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) <= most), F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & fits, F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """array<int> of floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Rows of integers out of a list column; lists shorter than the longest (or than ``dims``) are filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = max(int(sizes.max(initial=0)), dims or 0)
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``: in floating point where every partial sum is an integer
    that a double holds, else in integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
