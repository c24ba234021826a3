"""Squared-hinge machines against a plain solution of the same problem."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlens.reduce import learners, svm


def plain(x, y, c):
    """Newton steps, the best of many lengths each time."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    cost = lambda v: v @ v / 2 + c * (np.maximum(1 - y * (x @ v), 0) ** 2).sum()
    for _ in range(500):
        short = np.maximum(1 - y * (x @ w), 0)
        gradient = w - 2 * c * x.T @ (y * short)
        inside = x[short > 0]
        step = -np.linalg.solve(np.eye(len(w)) + 2 * c * inside.T @ inside, gradient)
        if np.abs(step).max() < 1e-13:
            break
        w = min((w + t * step for t in 0.5 ** np.arange(0, 40)), key=cost)
    return w


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    c = (x[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(int) + (x[:, 1] > 0.7).astype(int)
    rows = [(i, [float(v) for v in r], float(k), i % 3) for i, (r, k) in enumerate(zip(x, c))]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, y double, fold int").repartition(5)
    return x, c, df


@pytest.mark.parametrize("c", [1e-6, 0.03, 1.0, 1e3, 1e6])
def test_weights_equal_a_plain_solution(table, c):
    x, labels, df = table
    machines = [svm.Machine(k, c, left) for k in (0.0, 1.0, 2.0) for left in (-1, 0)]
    found = svm.solve(df, machines)
    for m, w in zip(machines, found):
        keep = np.arange(len(x)) % 3 != m.left_out
        want = plain(x[keep], np.where(labels[keep] == m.positive, 1.0, -1.0), c)
        assert np.abs(w - want).max() <= 1e-6 * max(1, np.abs(want).max())


def test_groups_of_machines_change_nothing(table, monkeypatch):
    df = table[2]
    machines = [svm.Machine(1.0, c) for c in (0.1, 1.0, 10.0)]
    whole = svm.solve(df, machines)
    monkeypatch.setattr(svm, "PASS_NUMBERS", 1)
    assert np.allclose(svm.solve(df, machines), whole, atol=1e-9)


@pytest.mark.parametrize("classes", [2, 3])
def test_search_equals_a_fit_for_each_fold(spark, table, classes):
    df = table[2].select("row_id", array_to_vector("x").alias("vec"), F.least("y", F.lit(classes - 1.0)).alias("y"), "fold")
    grid = [1e-4, 1.0, 100.0]
    found = learners.linear_svc_gridsearch("y", grid, classes).fit(df)
    for c, accuracy in zip(grid, found.avgMetrics):
        each = []
        for k in range(3):
            model = svm.SquaredHingeSvc(labelCol="y", featuresCol="vec", C=c, classes=classes).fit(df.where(F.col("fold") != k))
            each.append(model.transform(df.where(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0])
        assert accuracy == pytest.approx(np.mean(each), abs=1e-12)
    best = grid[int(np.argmax(found.avgMetrics))]
    again = svm.SquaredHingeSvc(labelCol="y", featuresCol="vec", C=best, classes=classes).fit(df)
    assert np.allclose(found.bestModel.weights, again.weights, atol=1e-8)
    assert learners.best_point(found)[0] == f"C={best:g}"


def test_not_converged_is_said(table, monkeypatch):
    monkeypatch.setattr(svm, "STEPS", 1)
    with pytest.raises(RuntimeError, match="not converged"):
        svm.solve(table[2], [svm.Machine(1.0, 1e3)])
