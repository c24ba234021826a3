"""Linear support vector machines with the squared hinge, and their search over the penalty.

A machine minimises |w|^2 / 2 + C sum max(0, 1 - y f)^2, f = w (x, 1) and y in -1, 1; the constant feature carries the
intercept. All penalties, folds and the whole table are solved in the same passes: one sums the loss, gradient and
curvature of every machine that is still moving, from which the driver takes Newton steps, the next one the loss after
steps of many lengths, of which the best is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, functions as F

from flowlens.functions.vectors import argmax, matrix_of, project
from flowlens.reduce.sums import feature_width, summed
from flowlens.session import drop_written, written

#: Newton steps; a machine stops when a step could lower its objective by less than this part of it.
STEPS, TOLERANCE = 200, 1e-14
#: Lengths of a step that are tried at once.
LENGTHS = np.concatenate([2.0 ** np.arange(-24, -4), np.arange(1, 25) / 16])
#: Numbers that a task sends in one pass: machines beyond it are solved in the next group.
PASS_NUMBERS = 4_000_000
#: Rows that a task holds as scores and products at a time.
PIECE = 2048
_ALL = -1


@dataclass(frozen=True)
class Machine:
    """One problem: its class against the rest, its penalty and the fold that it leaves out (-1: none)."""

    positive: float
    c: float
    left_out: int = _ALL


def solve(rows: DataFrame, machines: list[Machine], features: str = "x", label: str = "y", fold: str = "fold") -> np.ndarray:
    """[machine, feature + 1]: the weights of every machine, the intercept last. ``rows`` has an array column of features
    without nulls, a label and a fold. Raises if a machine has not converged after ``STEPS`` steps."""
    p = feature_width(rows, features) + 1
    packed = 1 + p + p * (p + 1) // 2
    group = max(1, PASS_NUMBERS // packed)
    found = [_solved(rows.select(features, label, fold), machines[i : i + group], p, packed) for i in range(0, len(machines), group)]
    return np.concatenate(found)


def _solved(rows: DataFrame, machines: list[Machine], p: int, packed: int) -> np.ndarray:
    penalty = np.array([m.c for m in machines])
    upper = np.triu_indices(p)
    same = np.array([[a.positive == b.positive and a.left_out == b.left_out for b in machines] for a in machines])
    w, moving, known = np.zeros((len(machines), p)), np.arange(len(machines)), np.zeros((len(machines), packed))
    for _ in range(STEPS):
        own, c = [machines[i] for i in moving], penalty[moving]
        known[moving] = summed(rows, len(moving) * packed, _curvature(own, w[moving], packed, upper)).reshape(len(moving), packed)
        # machines of other penalties on the same rows may have come further; their sums hold for this one too
        costs = np.where(same[moving], (w**2).sum(axis=1) / 2 + c[:, None] * known[:, 0], np.inf)
        start = np.where(costs.min(axis=1) < costs[np.arange(len(moving)), moving], costs.argmin(axis=1), moving)
        w[moving], known[moving] = w[start], known[start]
        sums, cost = known[moving], costs[np.arange(len(moving)), start]
        step, slope = np.zeros((len(moving), p)), np.zeros(len(moving))
        for at, i in enumerate(moving):
            gradient = w[i] - 2 * c[at] * sums[at, 1 : 1 + p]
            curve = np.zeros((p, p))
            curve[upper] = 2 * c[at] * sums[at, 1 + p :]
            curve = curve + np.triu(curve, 1).T + np.eye(p)
            step[at] = -np.linalg.solve(curve, gradient)
            slope[at] = gradient @ step[at]
        going = -slope > TOLERANCE * np.maximum(cost, 1e-300)
        if not going.any():
            return w
        moving, step, c, cost = moving[going], step[going], c[going], cost[going]
        losses = summed(rows, len(moving) * len(LENGTHS), _along([machines[i] for i in moving], w[moving], step))
        along = w[moving, None] + LENGTHS[:, None] * step[:, None]
        reached = (along**2).sum(axis=2) / 2 + c[:, None] * losses.reshape(len(moving), -1)
        best = reached.argmin(axis=1)
        better = reached[np.arange(len(moving)), best] < cost  # else rounding hides what is left to gain
        w[moving[better]] = along[np.nonzero(better)[0], best[better]]
        moving = moving[better]
        if not len(moving):
            return w
    raise RuntimeError(f"{len(moving)} of {len(machines)} machines have not converged")


def _with_one(batch: pa.Array) -> np.ndarray:
    x = matrix_of(batch)
    return np.hstack([x, np.ones((len(x), 1))])


def _pieces(machines: list[Machine], batch: pa.RecordBatch):
    """(features with the constant, signs, whether it counts) by row and machine, a piece of the batch at a time."""
    positive, left_out = np.array([m.positive for m in machines]), np.array([m.left_out for m in machines])
    for start in range(0, batch.num_rows, PIECE):
        part = batch.slice(start, PIECE)
        y = np.where(np.asarray(part[1])[:, None] == positive, 1.0, -1.0)
        yield _with_one(part[0]), y, np.asarray(part[2])[:, None] != left_out


def _curvature(machines: list[Machine], w: np.ndarray, packed: int, upper: tuple[np.ndarray, np.ndarray]):
    """(loss, sum of y (1 - y f) x, sum of x x') over the rows inside the margin, for each machine."""
    p = w.shape[1]

    def fold(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(machines), packed))
        for x, y, counts in _pieces(machines, batch):
            short = np.where(counts, np.maximum(1 - y * (x @ w.T), 0), 0)
            out[:, 0] += (short**2).sum(axis=0)
            out[:, 1 : 1 + p] += (y * short).T @ x
            for m in range(len(machines)):
                inside = x[short[:, m] > 0]
                out[m, 1 + p :] += (inside.T @ inside)[upper]
        return out.ravel()

    return fold


def _along(machines: list[Machine], w: np.ndarray, step: np.ndarray):
    """Loss of each machine after each of the lengths of its step."""

    def fold(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(machines), len(LENGTHS)))
        for x, y, counts in _pieces(machines, batch):
            margin, gain = np.where(counts, 1 - y * (x @ w.T), 0), np.where(counts, y * (x @ step.T), 0)
            for k, length in enumerate(LENGTHS):
                out[:, k] += (np.maximum(margin - length * gain, 0) ** 2).sum(axis=0)
        return out.ravel()

    return fold


class _Svc(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    C = Param(Params._dummy(), "C", "penalty of the summed loss", TypeConverters.toFloat)


class SquaredHingeSvc(Estimator, _Svc):
    """Labels are 0 ... classes - 1; with more than two, one machine for each class against the rest."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", featuresCol: str = "features", predictionCol: str = "prediction",
                 C: float = 1.0, classes: int = 2):
        super().__init__()
        self.classes = classes
        self._set(**{k: v for k, v in self._input_kwargs.items() if k != "classes"})
        self._setDefault(C=1.0, labelCol="label", featuresCol="features", predictionCol="prediction")

    def positives(self) -> list[float]:
        return [1.0] if self.classes == 2 else [float(k) for k in range(self.classes)]

    def rows(self, dataset: DataFrame, fold) -> DataFrame:
        return dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"),
                              fold.cast("int").alias("fold"))

    def _fit(self, dataset: DataFrame) -> SquaredHingeModel:
        rows = written(self.rows(dataset, F.lit(0)), "svm")
        weights = solve(rows, [Machine(k, self.getOrDefault(self.C)) for k in self.positives()])
        drop_written(rows)
        return self._copyValues(SquaredHingeModel(weights))


class SquaredHingeModel(Model, _Svc):
    """``weights``: [machine, feature + 1]; one machine decides by its sign, several by the largest score."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scores = project(vector_to_array(self.getFeaturesCol()), self.weights[:, :-1].T)
        scores = F.zip_with(scores, F.array(*[F.lit(float(b)) for b in self.weights[:, -1]]), lambda a, b: a + b)
        chosen = (F.get(scores, F.lit(0)) > 0).cast("int") if len(self.weights) == 1 else argmax(scores)
        return dataset.withColumn(self.getPredictionCol(), chosen.cast("double"))


class SvmSearch(CrossValidator):
    """Grid over ``C``: the machines of every point, fold and class, and those of the whole table, share their passes."""

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        svc, points = self.getEstimator(), self.getEstimatorParamMaps()
        folds, positives = self.getNumFolds(), svc.positives()
        rows = written(svc.rows(dataset, F.col(self.getFoldCol())), "svm")
        penalties = [float(point[svc.C]) for point in points]
        left_out = [*range(folds), _ALL]
        machines = [Machine(k, c, left) for c in penalties for left in left_out for k in positives]
        weights = solve(rows, machines).reshape(len(penalties), len(left_out), len(positives), -1)
        accuracy = fold_accuracy(rows, weights[:, :folds])
        drop_written(rows)
        best = int(np.argmax(accuracy))
        model = svc.copy(points[best])._copyValues(SquaredHingeModel(weights[best, -1]))
        return self._copyValues(CrossValidatorModel(model, accuracy.tolist()))


def fold_accuracy(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Mean over the folds that have rows of the share that each point gets right; ``weights``: [point, fold, class, feature]."""
    points, folds, classes, _ = weights.shape

    def count(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((folds, points + 1))
        for start in range(0, batch.num_rows, PIECE):
            part = batch.slice(start, PIECE)
            x, label, fold = _with_one(part[0]), np.asarray(part[1]), np.asarray(part[2])
            for k in range(folds):
                own = fold == k
                scores = np.einsum("rd,pcd->prc", x[own], weights[:, k], optimize=True)
                chosen = scores[:, :, 0] > 0 if classes == 1 else scores.argmax(axis=2)
                out[k, :points] += (chosen == label[own]).sum(axis=1)
                out[k, points] += own.sum()
        return out.ravel()

    found = summed(rows.select("x", "y", "fold"), folds * (points + 1), count).reshape(folds, points + 1)
    found = found[found[:, points] > 0]
    if not len(found):
        raise ValueError("no fold has rows to judge on")
    return (found[:, :points] / found[:, points:]).mean(axis=0)
