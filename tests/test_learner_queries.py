"""Queries of learners run the whole operator: library steps, runs and grids, all dimensions and splits."""

import pytest

from flowlens.plans import learner_queries as plans
from flowlens.plans.tables import matrix
from flowlens.reduce import experiment, learners, nets


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, points", [
    ("decision_tree_gridsearch", 300), ("best_params", 300), ("linear_svc_gridsearch", 20), ("logistic_gridsearch", 20)])
def test_whole_grid(spark, sf_dir, monkeypatch, name, points):
    def fit(self, rows):
        raise Seen(len(self.getEstimatorParamMaps()))

    monkeypatch.setattr(learners.CrossValidator, "fit", fit)
    with pytest.raises(Seen, match=f"^{points}$"):
        getattr(plans, name)(spark, sf_dir)


def test_library_steps():
    for maker in (nets.ae_category, nets.ae_binary, nets.ae_unsupervised, nets.net_supervised):
        net, default = plans._net(maker), maker(2)
        assert (net.steps, net.lr) == (default.steps, default.lr)


@pytest.mark.parametrize("name, runs", [("compare_spaces", 1), ("ensemble_runs", 5), ("weights_report", 5)])
def test_library_runs_and_classifiers(spark, sf_dir, monkeypatch, name, runs):
    """A reducer without a random start needs one run."""
    def fit(self, data):
        raise Seen(self.runs, self.classifiers)

    monkeypatch.setattr(experiment.Experiment, "fit", fit)
    with pytest.raises(Seen) as seen:
        getattr(plans, name)(spark, sf_dir)
    assert seen.value.args == (runs, learners.CLASSIFIERS)


def test_all_dimensions_and_splits(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(plans, "_net", lambda maker, **options: maker(2, steps=1, **options))
    report = plans.weights_report(spark, sf_dir)
    assert {(r.dim, r["count"]) for r in report.groupBy("dim").count().collect()} == {(0, 64), (1, 64)}
    assert len(report.columns) == 2 + 2 * 5
    stored = plans.embedding_store(spark, sf_dir)
    assert {r.split for r in stored.select("split").distinct().collect()} == {"train", "val", "test"}
    assert stored.count() == matrix(spark, sf_dir).count()


@pytest.fixture(scope="module")
def train(spark, sf_dir):
    return plans.written(plans._vectors(spark, sf_dir, "category").where("split = 'train'"), "train")


def test_search_by_prefixes_equals_a_fit_for_each_point(train):
    depths, leaves = [2, 3, 5, 9, 26], [2, 7]
    search = learners.decision_tree_gridsearch("y", depths, leaves)
    found = search.fit(train)
    every = learners._search(search.getEstimator(), search.getEstimatorParamMaps(), "y", 3, 1).fit(train)
    assert found.avgMetrics == pytest.approx(every.avgMetrics, abs=1e-12)
    assert learners.best_point(found) == learners.best_point(every)
    assert found.bestModel.toDebugString.split("\n")[1:] == every.bestModel.toDebugString.split("\n")[1:]


def test_points_beyond_the_deepest_tree_count_like_it(train):
    found = dict(learners.search_points(learners.decision_tree_gridsearch("y", [26, 34, 256], [2]).fit(train)))
    assert len(set(found.values())) == 1 and len(found) == 3


def test_trees_of_a_search_have_few_partitions(train, monkeypatch):
    """They grow side by side; every partition would send the statistics of all nodes of each."""
    seen = []
    fit = learners.DecisionTreeClassifier.fit
    monkeypatch.setattr(learners.DecisionTreeClassifier, "fit", lambda self, rows, *a: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows, *a))
    learners.decision_tree_gridsearch("y", [3], [2, 5]).fit(train.repartition(6))
    assert seen[:6] == [1] * 6 and len(seen) == 7


def test_votes_at_every_depth(spark, train):
    from pyspark.sql import functions as F

    deep = learners.decision_tree("y").setMinInstancesPerNode(3).fit(train)
    votes = learners.depth_votes(deep, [1, 4, 30])
    leaf = deep.copy().setLeafCol("leaf").transform(train).select("row_id", "leaf")
    for k, depth in enumerate((1, 4, 30)):
        flat = learners.decision_tree("y").setMinInstancesPerNode(3).setMaxDepth(depth).fit(train).transform(train)
        for r in flat.join(leaf, "row_id").select("prediction", F.col("leaf").cast("int").alias("leaf")).collect():
            assert votes[r.leaf, k] == r.prediction


def test_classifiers_from_the_registry_and_their_best_points(spark, monkeypatch):
    rows = [(i, [float(i % 12), 0.0], (i % 12) // 3, int(i % 12 < 6), "train" if i % 3 else "val") for i in range(240)]
    data = spark.createDataFrame(rows, "row_id long, features array<double>, category int, label int, split string")
    monkeypatch.setattr(learners, "C_GRID", [0.01, 100.0])
    trial = experiment.Experiment(plans.linear.PcaReducer(1), classifiers={"Logistic Regression": learners.REGISTRY["Logistic Regression"]})
    scores = experiment.compare_spaces(data, "original", 0, trial.classifiers, "features", searches=trial.searches)
    best = trial.best_parameters(spark).collect()
    assert [(r.classifier, r.task, r.space) for r in best] == [("Logistic Regression", t, "original") for t in ("binary", "category")]
    assert best[0].accuracy == 1.0 and best[0].params.startswith("regParam=")
    assert {r.value for r in scores.where("task = 'binary' AND metric = 'accuracy'").collect()} == {1.0}
