"""What the two vector operators share: which vectors count, and blocks of them in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(col):
    """Not null, not empty, all components finite, one above or below zero."""
    fine = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(col.isNotNull() & fine & F.exists(col, lambda x: x != 0), F.lit(False))


def of_one_length(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """Rows whose vectors have the most frequent length (the shorter on ties), and that length; 0 without rows."""
    lengths = rows.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    n = lengths.n if lengths else 0
    return rows.where(F.size(vector_col) == n), n


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Of a column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def number_of(rows: DataFrame, vector_col: str) -> pa.DataType:
    """Arrow's type of the components of a column of vectors."""
    return pa.float32() if rows.schema[vector_col].dataType.simpleString() == "array<float>" else pa.float64()


def lists(x: np.ndarray, kind=pa.float64()) -> pa.ListArray:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d, pa.int32()), pa.array(x.reshape(-1).astype(kind.to_pandas_dtype(), copy=False), kind))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distance of paired rows; squares are summed in order of component, as SQL engines do."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        d = q[:, k] - x[:, k]
        total += d * d
    return np.sqrt(total)
