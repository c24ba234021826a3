"""Distances of every row to a bounded set of reference rows.

Landmarks are a sample with a fixed size bound, so they are broadcast with the task; the work is one
matrix product per Arrow batch and grows linearly with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from flowlens.functions.vectors import list_column, matrix_of

MAX_LANDMARKS = 20_000


def hash_sample(df: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """The ``count`` rows first in hash order of a unique key: the same rows for any partitioning.

    On tables much larger than the sample only rows below a hash bound enter the ordering, so a task never
    hands over its own ``count`` rows; the bound leaves room for chance, and a short sample falls back to none.
    """
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    total = df.count()
    if total > 4 * count:
        share = (count + 10 * count ** 0.5 + 100) / total
        below = df.where(place < int((1 << 40) * share))
        if share < 1 and below.count() >= count:
            df = below
    return df.orderBy(place, key).limit(count)


def choose_landmarks(df: DataFrame, key: str, count: int, order: Column | None = None, seed: int = 0) -> DataFrame:
    """A repeatable sample with a checked bound; ``order`` replaces the hash order."""
    if count > MAX_LANDMARKS:
        raise ValueError(f"at most {MAX_LANDMARKS} landmarks")
    return hash_sample(df, key, count, seed) if order is None else df.orderBy(order, key).limit(count)


def fetch(landmarks: DataFrame, key: str, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and feature matrix of a landmark sample."""
    table = landmarks.select(F.col(key), F.col(features).cast("array<double>")).limit(MAX_LANDMARKS + 1).toArrow()
    if table.num_rows > MAX_LANDMARKS:
        raise ValueError(f"at most {MAX_LANDMARKS} landmarks")
    return table[key].to_numpy(), matrix_of(table[features]) if table.num_rows else np.zeros((0, 1))


def squared_distances(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Summed squares of differences, computed by blocks of columns of ``base``; exact zeros for equal rows."""
    out = np.empty((len(x), len(base)))
    block = max(1, 2_000_000 // max(1, x.size))
    for at in range(0, len(base), block):
        part = base[at:at + block]
        out[:, at:at + block] = np.square(x[:, None, :] - part[None, :, :]).sum(axis=2)
    return out


def fast_squared_distances(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The same by one matrix product; rounding is relative to the norms."""
    square = (x * x).sum(axis=1)[:, None] + (base * base).sum(axis=1)[None, :] - 2 * x @ base.T
    return np.maximum(square, 0.0)


def landmark_distances(features, base: np.ndarray) -> Column:
    """Array of squared Euclidean distances, one per landmark."""

    @arrow_udf("array<double>")
    def apply(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], pa.list_(pa.float64()))
        return list_column(squared_distances(matrix_of(batch), base))

    return apply(features)


def affinities(square: np.ndarray, perplexity: float, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise Gaussian shares over neighbour distances with entropy log(perplexity), and the precisions.

    Rows bisect their precision together, in log space between brackets that hold any finite answer.
    """
    shifted = square - square.min(axis=1, keepdims=True)
    scale = np.maximum(shifted.mean(axis=1), 1e-300)
    low, high = np.full(len(square), -60.0), np.full(len(square), 60.0)
    target = np.log(min(perplexity, square.shape[1]))
    for _ in range(rounds):
        middle = (low + high) / 2
        beta = np.exp(middle) / scale
        power = np.exp(-np.minimum(shifted * beta[:, None], 700.0))
        total = power.sum(axis=1)
        entropy = np.log(total) + beta * (shifted * power).sum(axis=1) / total
        wide = entropy > target
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    return power / total[:, None], beta
