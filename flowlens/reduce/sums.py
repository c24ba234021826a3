"""Sums of per-batch NumPy results over a whole table: the one primitive behind scatter matrices and gradients."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

# vectors at least this long are added in two rounds, so no single task receives one from every other task
_WIDE = 1024
_FAN = 64


def summed(df: DataFrame, width: int, fold: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of ``fold(batch)`` over all Arrow batches of ``df``; one vector leaves each task."""

    def partial(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += fold(batch)
        slot = TaskContext.get().partitionId() % _FAN
        yield pa.RecordBatch.from_arrays(
            [pa.array([slot], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["slot", "part"]
        )

    parts = df.mapInArrow(partial, "slot int, part array<double>")
    vector = array_to_vector(F.col("part"))
    if width >= _WIDE:
        parts = parts.groupBy("slot").agg(Summarizer.sum(vector).alias("v"))
        vector = F.col("v")
    total = parts.agg(Summarizer.sum(vector).alias("v")).select(vector_to_array("v").alias("v")).first().v
    return np.asarray(total) if total is not None and len(total) else np.zeros(width)


def feature_width(df: DataFrame, features: str = "features") -> int:
    row = df.select(F.size(features).alias("d")).first()
    if row is None:
        raise ValueError("the table has no rows")
    return row.d


def moments(df: DataFrame, features: str = "features") -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, mean and covariance (n - 1) from one pass.

    Products are taken around a reference row, which keeps the subtraction of means well conditioned.
    """
    from flowlens.functions.vectors import matrix_of

    d = feature_width(df, features)
    origin = np.asarray(df.select(features).first()[0], dtype=np.float64)

    def fold(batch):
        x = matrix_of(batch[0]) - origin
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    out = summed(df.select(features), 1 + d + d * d, fold)
    n, s, q = out[0], out[1:1 + d], out[1 + d:].reshape(d, d)
    return n, origin + s / n, (q - np.outer(s, s) / n) / max(n - 1, 1)


def class_scatter(df: DataFrame, label: str, classes: list[int], features: str = "features"):
    """Per-class counts and means, and the pooled within-class scatter, from one pass."""
    from flowlens.functions.vectors import matrix_of

    d, k = feature_width(df, features), len(classes)
    origin = np.asarray(df.select(features).first()[0], dtype=np.float64)
    known = np.asarray(classes)

    def fold(batch):
        x = matrix_of(batch[0]) - origin
        member = (batch[1].to_numpy(zero_copy_only=False)[:, None] == known).astype(np.float64)
        return np.concatenate([member.sum(axis=0), (member.T @ x).ravel(), (x.T @ x).ravel()])

    out = summed(df.select(features, label), k + k * d + d * d, fold)
    n, sums, q = out[:k], out[k:k + k * d].reshape(k, d), out[k + k * d:].reshape(d, d)
    means = sums / np.maximum(n, 1)[:, None]
    return n, means + origin, q - (means * n[:, None]).T @ means


def fix_signs(components: np.ndarray) -> np.ndarray:
    """Columns flipped so that the entry of largest magnitude is positive."""
    at = np.abs(components).argmax(axis=0)
    return components * np.where(components[at, np.arange(components.shape[1])] < 0, -1.0, 1.0)
