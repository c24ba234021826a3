"""Hashed neighbour graphs and the map laid out on them."""

import numpy as np
import pytest

from flowlens.operators import hashed, knn
from flowlens.reduce import tsne
from flowlens.reduce.experiment import Experiment


def blobs(groups, each, width, spread, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([c + rng.normal(size=(each, width)) for c in rng.normal(size=(groups, width)) * spread])


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "row_id long, features array<double>").repartition(4)


def nearest(x, k):
    d2 = np.square(x[:, None] - x[None]).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    return np.argsort(d2, axis=1, kind="stable")[:, :k]


def shared(a, b):
    return np.mean([len(set(p) & set(q)) / len(p) for p, q in zip(a, b)])


def graph_of(df, n, k):
    out = np.full((n, k), -1)
    for r in df.collect():
        out[r.row_id, r["rank"]] = r.neighbour
    return out


def test_one_bucket_is_exact(spark):
    data = frame(spark, blobs(3, 60, 8, 2.0))
    got = {tuple(r) for r in hashed.hashed_knn(data, 7).select("row_id", "neighbour", "rank").collect()}
    assert got == {tuple(r) for r in knn.exact_knn(data, 7).select("row_id", "neighbour", "rank").collect()}


def test_recall_over_many_small_buckets(spark):
    x = blobs(12, 150, 16, 3.0)
    found = graph_of(hashed.hashed_knn(frame(spark, x), 10, bucket=200, tables=16), len(x), 10)
    assert shared(nearest(x, 10), found) >= 0.9
    assert (found >= 0).all()


def test_buckets_are_bounded_and_copies_are_dealt_out(spark):
    x = np.concatenate([np.zeros((700, 4)), blobs(2, 50, 4, 1.0)])
    coded = hashed.sign_codes(frame(spark, x), "row_id", "features", 2)
    units = hashed.bucketed(coded, 100)
    sizes = [r["count"] for r in units.groupBy("unit").count().collect()]
    assert sum(sizes) == 2 * len(x) and max(sizes) < 160
    same = hashed.hashed_knn(frame(spark, x), 3, bucket=100, tables=2)
    assert {r.d2 for r in same.where("row_id < 700").collect()} == {0.0}


def test_a_step_follows_the_gradient(spark):
    """One step from rest goes down the divergence between the affinities and the map's own shares."""
    rng = np.random.default_rng(1)
    y = rng.normal(size=(12, 2))
    p = rng.random((12, 12))
    p = (p + p.T) * (1 - np.eye(12))
    p /= p.sum()

    def loss(y):
        w = 1 / (1 + np.square(y[:, None] - y[None]).sum(axis=2)) * (1 - np.eye(12))
        q = w / w.sum()
        at = p > 0
        return float((p[at] * np.log(p[at] / q[at])).sum())

    i, j = np.nonzero(p)
    cells = (y.min(axis=0), 1.0, np.zeros((0, 5)))
    moved, *_ = tsne.descend(y, np.zeros_like(y), np.ones_like(y) / 0.8, (i, j, p[i, j]), np.zeros((0, 2)), cells, 1, 1.0, 0.0, 1e-6, 0.0)
    slope = np.zeros_like(y)
    for r in range(12):
        for d in range(2):
            step = np.zeros_like(y)
            step[r, d] = 1e-5
            slope[r, d] = (loss(y + step) - loss(y - step)) / 2e-5
    found = (y - moved) / 1e-6
    assert np.allclose(found / found.max(), slope / slope.max(), atol=1e-3)


@pytest.mark.parametrize("group, steps", [(2000, 100), (120, 100)])
def test_neighbours_stay_neighbours(spark, group, steps):
    x = blobs(6, 50, 20, 4.0)
    data = frame(spark, x)
    model = tsne.TsneReducer(2, perplexity=15, steps=steps, group=group).fit(data)
    rows = {r.row_id: r.embedding for r in model.transform(data).collect()}
    assert sorted(rows) == list(range(len(x)))
    y = np.array([rows[i] for i in range(len(x))])
    flat = (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2].T
    near = nearest(x, 10)
    assert shared(near, nearest(y, 10)) > max(0.35, 1.2 * shared(near, nearest(flat, 10)))
    blob = np.arange(len(x)) // 50
    assert (blob[nearest(y, 5)] == blob[:, None]).mean() > 0.95


def test_all_splits_are_laid_out(spark):
    data = frame(spark, blobs(2, 20, 5, 2.0)).selectExpr("*", "CASE WHEN row_id % 4 = 0 THEN 'test' ELSE 'train' END AS split")
    trial = Experiment(tsne.TsneReducer(2, perplexity=5, steps=10)).fit(data)
    assert trial.runs == 1 and trial.models[0].transform(data).where("embedding IS NULL").count() == 0
    with pytest.raises(ValueError):
        tsne.TsneReducer(3)
