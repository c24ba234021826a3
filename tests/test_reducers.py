"""Reducers and learners against dense NumPy solutions and basic sanity."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlens.reduce import base, experiment, learners, linear, nets, sums


@pytest.fixture(scope="module")
def blobs(spark):
    """Three Gaussian groups in five dimensions (two of them collinear), with all the columns of a dataset."""
    rng = np.random.default_rng(7)
    y = np.repeat([0, 4, 9], 60)
    x = rng.normal(0, 1, (180, 4)) + np.eye(4)[[0, 1, 2]][np.repeat([0, 1, 2], 60)] * 5
    x = np.column_stack([x, x[:, 0] * 2])
    split = np.where(np.arange(180) % 5 == 0, "test", np.where(np.arange(180) % 5 == 1, "val", "train"))
    rows = [(i, x[i].tolist(), int(y[i] != 9), int(y[i]), str(split[i])) for i in range(180)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label int, category int, split string")
    return df.coalesce(2).persist(), x, y


def collected(df, column="embedding"):
    return np.array([r[column] for r in df.orderBy("row_id").collect()])


@pytest.mark.parametrize("partitions", [1, 5])
def test_moments(blobs, partitions):
    df, x, _ = blobs
    n, mean, cov = sums.moments(df.repartition(partitions))
    assert n == 180 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))


def test_wide_sums_take_two_rounds(blobs, monkeypatch):
    df, x, _ = blobs
    monkeypatch.setattr(sums, "_WIDE", 4)
    assert np.allclose(sums.moments(df.repartition(5))[2], np.cov(x.T))


def test_pca_equals_eigh(blobs):
    df, x, _ = blobs
    model = linear.PcaReducer(2).fit(df)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    axes = sums.fix_signs(vectors[:, ::-1][:, :2])
    assert np.allclose(model.feature_matrix()[:, :2], axes, atol=1e-8)
    assert np.allclose(collected(model.transform(df)), (x - x.mean(0)) @ axes, atol=1e-8)
    assert model.feature_matrix().shape == (5, 5)


def test_lda_equals_dense_solution(blobs):
    df, x, y = blobs
    model = linear.LdaReducer(2, categories=True).fit(df)
    z = collected(model.transform(df))
    within = sum((z[y == c] - z[y == c].mean(0)).T @ (z[y == c] - z[y == c].mean(0)) for c in set(y)) / (180 - 3)
    assert np.allclose(within, np.eye(2), atol=1e-8)  # whitened within classes
    keep = [0, 1, 2, 3]  # the fifth column is twice the first
    d = x[:, keep]
    sw = sum((d[y == c] - d[y == c].mean(0)).T @ (d[y == c] - d[y == c].mean(0)) for c in set(y))
    sb = sum((y == c).sum() * np.outer(d[y == c].mean(0) - d.mean(0), d[y == c].mean(0) - d.mean(0)) for c in set(y))
    ratio = np.sort(np.linalg.eigvals(np.linalg.solve(sw, sb)).real)[::-1][:2]
    between = [sum((y == c).sum() * z[y == c, k].mean() ** 2 for c in set(y)) / (180 - 3) for k in (0, 1)]
    assert np.allclose(between, ratio)


def test_lda_size_is_limited_by_the_classes(blobs):
    with pytest.warns(UserWarning, match="allow 1"):
        model = linear.LdaReducer(2).fit(blobs[0])
    assert model.meta["size"] == 1


@pytest.mark.parametrize("head", ["category", "binary", "none"])
@pytest.mark.parametrize("reconstruct", ["binary_crossentropy", "mse", "none"])
@pytest.mark.parametrize("norm", ["l1", "l2"])
def test_gradient_equals_finite_differences(head, reconstruct, norm):
    if head == "none" and reconstruct == "none":
        pytest.skip("no loss")
    spec = nets.NetSpec(head, reconstruct, 0.3, norm, 0.05, 0.02)
    rng = np.random.default_rng(0)
    x, shapes = rng.random((9, 4)), spec.shapes(4, 2)
    y = rng.integers(0, 2 if head == "binary" else 10, 9).astype(float)
    theta = nets.initial(shapes, 1) + rng.normal(0, 0.1, sum(int(np.prod(s)) for s in shapes.values()))

    def total(t):
        return nets.data_loss(t, shapes, spec, x, y)[0] + nets.penalty(t, shapes, spec)[0]

    grad = nets.data_loss(theta, shapes, spec, x, y)[1] + nets.penalty(theta, shapes, spec)[1]
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert (total(theta + step) - total(theta - step)) / 2e-6 == pytest.approx(grad[i], abs=1e-5)


def test_net_learns_and_does_not_depend_on_partitions(blobs):
    df, _, y = blobs
    reducer = nets.ae_category(2, steps=25, lr=0.3, enc_regularizer_weight=0.0, reconstruct="mse")
    one, many = reducer.fit(df.coalesce(1)), reducer.fit(df.repartition(6))
    assert np.allclose(one.params_["W"], many.params_["W"], atol=1e-6)
    loss = [l for l, _ in one.meta["history"]]
    assert loss[-1] < loss[0] / 2
    predicted = collected(df.withColumn("s", one.label_scores()), "s").argmax(axis=1)
    assert (predicted == y).mean() > 0.9
    assert one.history(df.sparkSession).count() == 25


def test_mini_batches_inside_a_pass(blobs):
    df = blobs[0]
    model = nets.ae_binary(2, steps=8, lr=0.05, batch_size=10, enc_regularizer_weight=0.0).fit(df.repartition(2))
    loss = [l for l, _ in model.meta["history"]]
    assert loss[-1] < loss[0]


def test_runs_trained_together_equal_runs_trained_alone(blobs):
    df = blobs[0]
    reducer = nets.ae_unsupervised(2, steps=5, lr=0.1)
    together = reducer.fit_runs(df, 2)
    alone = reducer.with_run(1).fit(df)
    assert np.allclose(together[1].params_["W"], alone.params_["W"], atol=1e-9)
    assert not np.allclose(together[0].params_["W"], together[1].params_["W"])


def test_unsupervised_has_no_label_head_and_supervised_has_an_embedding(blobs):
    df = blobs[0]
    with pytest.raises(ValueError):
        nets.ae_unsupervised(2, steps=1).fit(df).label_scores()
    assert collected(nets.net_supervised(2, steps=1).fit(df).transform(df)).shape == (180, 2)


def test_plateau_halves_the_rate():
    plateau = nets.Plateau(0.1)
    for _ in range(6):
        plateau.see(1.0)
    assert plateau.lr == 0.05
    for _ in range(8):
        plateau.see(1.0)
    assert plateau.lr == 0.05  # cooling down
    plateau.see(1.0)
    assert plateau.lr == 0.025


def test_options_are_checked():
    for bad in ({"enc_regularizer": "l3"}, {"reconstruct": "mae"}, {"head": "many"}):
        with pytest.raises(ValueError):
            nets.NetSpec(**bad)


def test_mds_recovers_planar_distances(spark):
    rng = np.random.default_rng(4)
    plane = rng.normal(0, 3, (120, 2))
    turn, _ = np.linalg.qr(rng.normal(0, 1, (6, 6)))
    x = plane @ turn[:2] + rng.normal(0, 1, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    z = collected(linear.MdsReducer(2).fit(df).transform(df))
    gap = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    assert np.allclose(gap(z), gap(plane), atol=1e-7)


def test_saved_models_load_equal(spark, blobs, tmp_path):
    df = blobs[0]
    models = [linear.PcaReducer(2).fit(df), linear.LdaReducer(2, categories=True).fit(df),
              nets.ae_category(1, steps=1).fit(df), linear.MdsReducer(2).fit(df)]
    for i, model in enumerate(models):
        path = str(tmp_path / str(i))
        assert not base.models_exist(spark, path)
        base.save_models(spark, [model, model], path)
        assert base.models_exist(spark, path)
        loaded = base.load_models(spark, path)[1]
        assert type(loaded) is type(model)
        assert np.allclose(collected(loaded.transform(df)), collected(model.transform(df)))


def test_reducer_is_a_pipeline_stage(blobs):
    df = blobs[0]
    out = Pipeline(stages=[linear.PcaReducer(3)]).fit(df).transform(df)
    assert len(out.first().embedding) == 3


def test_tree_search_and_best_params(spark, blobs):
    df = blobs[0].select("row_id", array_to_vector("features").alias("vec"), F.col("label").cast("double").alias("y"),
                         learners.fold_column().alias("fold"))
    search = learners.decision_tree_gridsearch("y", depths=[2, 3], leaves=[2, 40]).fit(df)
    table = learners.search_table(search, spark)
    top = learners.best_params(table).first()
    assert table.count() == 4 and top.accuracy == max(r.accuracy for r in table.collect()) > 0.9
    shown = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.5)], table.schema)
    assert learners.best_params(shown).first().params == "a"


@pytest.mark.parametrize("search,classes", [("logistic", 2), ("svc", 3)])
def test_linear_searches_separate(blobs, search, classes):
    label = "label" if classes == 2 else "c"
    df = blobs[0].withColumn("c", (F.col("category") / 4).cast("int")).select(
        "row_id", array_to_vector("features").alias("vec"), F.col(label).cast("double").alias("y"),
        learners.fold_column(label="category").alias("fold"))
    maker = learners.logistic_gridsearch("y", 180, [1.0]) if search == "logistic" else (
        learners.linear_svc_gridsearch("y", [1.0], classes))
    out = maker.fit(df).transform(df)
    assert out.where(F.col("prediction") == F.col("y")).count() > 165


def test_experiment_scores(blobs):
    df = blobs[0]
    trial = experiment.Experiment(linear.PcaReducer(2), 2, {"Decision Tree": learners.decision_tree}).fit(df)
    scores = trial.scores(df).persist()
    cells = {(r.run, r.task, r.space, r.split) for r in scores.collect()}
    assert len(cells) == 2 * 2 * 2 * 3
    f1 = scores.where("metric = 'f1' AND space = 'original' AND split = 'test'").collect()
    assert len(f1) == 2 and all(r.value > 0.9 for r in f1)
    std = trial.std(scores).where("space = 'original'")
    assert std.where("value <> 0").count() == 0  # scored once, equal in every run


def test_custom_reducer_and_clusterer(blobs):
    df = blobs[0]

    class FirstTwo(base.Reducer):
        name = "first_two"

        def _fit(self, dataset):
            return linear.LinearModel("pca", {"components": np.eye(5)[:, :2], "mean": np.zeros(5)}, meta={"size": 2})

    trial = experiment.Experiment(FirstTwo(), 1, {}, {"K-Means": lambda label: learners.kmeans(label, 3)}).fit(df)
    scores = trial.scores(df)
    assert scores.select("metric").distinct().count() == 8
    assert scores.where("task = 'category' AND space = 'original' AND metric = 'adj_rand_index'").agg(
        F.min("value")).first()[0] > 0.8


def test_load_refuses_other_models(spark, blobs, tmp_path):
    df, path = blobs[0].withColumn("split", F.lit("train")), str(tmp_path / "saved")
    experiment.Experiment(nets.ae_category(1, steps=1), 1).fit(df).save(spark, path)
    assert len(experiment.Experiment(nets.ae_category(1, steps=1), 1).load(spark, path).models) == 1
    for other, runs in ((nets.ae_binary(1), 1), (nets.ae_category(2), 1), (nets.ae_category(1), 2),
                        (nets.ae_category(1, reconstruct_weight=0.7), 1)):
        with pytest.raises(ValueError):
            experiment.Experiment(other, runs).load(spark, path)
