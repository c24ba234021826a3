"""Principal components, classical scaling and Fisher discriminants."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.vectors import project
from flowlens.reduce.base import Reducer, ReducerModel
from flowlens.reduce.sums import class_scatter, fix_signs, moments


class LinearModel(ReducerModel):
    """embedding = (x - mean) @ components[:, :size]."""

    def embedding(self) -> Column:
        return project(self.features, self.params_["components"][:, : self.meta["size"]], self.params_["mean"])

    def feature_matrix(self) -> np.ndarray:
        return self.params_["components"]


def principal_axes(dataset: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, all axes in order of falling variance, and their shares of it: one pass, a d x d problem on the driver."""
    _, mean, covariance = moments(dataset, features)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    values = np.maximum(values[order], 0)
    return mean, fix_signs(vectors[:, order]), values / max(values.sum(), 1e-300)


class PcaReducer(Reducer):
    """Principal components of one pass over the rows, all of them kept."""

    name = "pca"

    def _fit(self, dataset: DataFrame) -> LinearModel:
        mean, axes, share = principal_axes(dataset, self.features)
        return LinearModel(self.name, {"components": axes, "mean": mean, "variance_share": share}, self.features, self.output,
                           {"size": min(self.size, len(mean)), "flat": ["mean", "variance_share"]})


class MdsReducer(Reducer):
    """Classical scaling: the map of all rows whose distances fit theirs best in the sense of inner products.

    For Euclidean distances that map is the projection on the first principal axes of the same rows, so no distance
    matrix and no sample is needed.
    """

    name = "mds"

    def _fit(self, dataset: DataFrame) -> MdsModel:
        mean, axes, _ = principal_axes(dataset, self.features)
        size = min(self.size, len(mean))
        return MdsModel(self.name, {"components": axes[:, :size], "mean": mean}, self.features, self.output,
                        {"size": size, "flat": ["mean"]})


class MdsModel(LinearModel):
    def feature_matrix(self) -> np.ndarray:
        raise NotImplementedError("a distance map has no feature weights")


class LdaReducer(Reducer):
    """Fisher discriminant of the binary or the category label.

    Class moments come from one distributed pass; the d x d problem is solved on the driver.
    Collinear directions (one-hot blocks) are dropped before whitening.
    """

    name = "lda"

    def __init__(self, size: int = 2, categories: bool = False, features: str = "features",
                 output: str = "embedding", max_classes: int = 1000, tolerance: float = 1e-4):
        super().__init__(size, features, output)
        self.label = "category" if categories else "label"
        self.max_classes, self.tolerance = max_classes, tolerance

    def _fit(self, dataset: DataFrame) -> LinearModel:
        rows = dataset.select(F.col(self.label).cast("int").alias("c")).distinct().limit(self.max_classes + 1).collect()
        classes = sorted(r.c for r in rows if r.c is not None)
        if len(rows) > self.max_classes or len(classes) < 2:
            raise ValueError(f"need 2..{self.max_classes} classes, found {len(rows)}")
        n, means, within = class_scatter(dataset, self.label, classes, self.features)
        total, k = n.sum(), len(classes)
        mean = (n[:, None] * means).sum(axis=0) / total
        scalings = discriminant_axes(n, means, within, self.tolerance)
        size = min(self.size, k - 1, scalings.shape[1])
        if size < self.size:
            warnings.warn(f"{k} classes allow {size} discriminant(s), not {self.size}", stacklevel=2)
        return LinearModel(self.name, {"components": scalings[:, :size], "mean": mean}, self.features, self.output,
                           {"size": size, "requested": self.size, "flat": ["mean"]})


def discriminant_axes(n: np.ndarray, means: np.ndarray, within: np.ndarray, tolerance: float) -> np.ndarray:
    """Axes in which the within-class covariance is the identity, in order of between-class spread."""
    total, k = n.sum(), len(n)
    covariance = within / max(total - k, 1)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0))
    spread[spread == 0] = 1.0
    values, vectors = np.linalg.eigh(covariance / np.outer(spread, spread))
    kept = np.sqrt(np.maximum(values, 0)) > tolerance
    whitening = vectors[:, kept] / spread[:, None] / np.sqrt(values[kept])
    mean = (n[:, None] * means).sum(axis=0) / total
    between = np.sqrt(n / max(k - 1, 1))[:, None] * (means - mean) @ whitening
    _, sizes, axes = np.linalg.svd(between, full_matrices=False)
    rank = int((sizes > tolerance * sizes[0]).sum()) if sizes.size and sizes[0] > 0 else 0
    return fix_signs(whitening @ axes[:rank].T)
