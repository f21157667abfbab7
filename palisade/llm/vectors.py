"""Vectors as Arrow lists and as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column | str) -> Column:
    """Whether a vector is there, not empty, and all its components are finite numbers."""
    column = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & fine, F.lit(False))


def matrix(lists: pa.Array, dtype: type = np.float64) -> np.ndarray:
    """One row per list; all lists have one length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), dtype)


def dimension(vectors: DataFrame, column: str) -> int:
    """The commonest length of the vectors (the larger on a tie); 0 without rows. Vectors of other
    lengths can be compared with none of these."""
    row = (
        vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    )
    return row["d"] if row else 0


def as_lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))
