"""Array expressions and the Arrow projection shared by all linear reducers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf


def argmax(array) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def one_hot_of(position, width: int) -> Column:
    """Array of ``width`` zeros with a one at the 0-based ``position``."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == position).cast("int"))


def threshold(score) -> Column:
    """0/1 from a score, rounding half to even (0.5 gives 0)."""
    return F.rint(score).cast("int")


def matrix_of(column: pa.Array) -> np.ndarray:
    """n x d view of an Arrow list column without a per-row copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def list_column(values: np.ndarray) -> pa.Array:
    """Arrow list<double> column from an n x k matrix."""
    n, k = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def project(features, matrix: np.ndarray, offset: np.ndarray | None = None) -> Column:
    """``(x - offset) @ matrix`` for every row, batch-wise."""
    matrix = np.asarray(matrix, dtype=np.float64)
    shift = (np.zeros(matrix.shape[0]) if offset is None else np.asarray(offset, dtype=np.float64)) @ matrix

    @arrow_udf("array<double>")
    def apply(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], pa.list_(pa.float64()))
        return list_column(matrix_of(batch) @ matrix - shift)

    return apply(features)
