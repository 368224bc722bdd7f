"""Helpers of the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Vectors with at least one component, none of them NULL or not finite."""
    bad = F.exists(
        embedding,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def dimensions(vectors: DataFrame, column: str) -> list[int]:
    """The lengths that occur; vectors of other lengths are never compared."""
    rows = vectors.select(F.size(column).alias("n")).distinct().collect()
    return sorted(row["n"] for row in rows)
