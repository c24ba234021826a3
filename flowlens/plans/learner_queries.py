"""Reducers, classifiers, experiments and their stores, with the sums they rest on checked against SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.vectors import argmax, list_column, project
from flowlens.operators import classification, hashed, knn, landmarks, scores as reports
from flowlens.plans.registry import query, r6, round_sql, rounded
from flowlens.plans.tables import flows, matrix, oracle
from flowlens.reduce import base, experiment, learners, linear, nets, sums, tsne
from flowlens.session import work_path, written
from flowlens.sources import stores

# the SQL of model_registry expects two runs; every other query uses the library's steps, runs and grids
_REGISTRY_RUNS = 2


def _net(maker, **options):
    return maker(2, **options)


def _split_columns(df: DataFrame, column: str, size: int) -> DataFrame:
    return df.select("row_id", "split", *[F.get(column, F.lit(i)).alias(f"e{i}") for i in range(size)])


def _long_matrix(spark: SparkSession, values: np.ndarray) -> DataFrame:
    rows = [(i, j, float(values[i, j])) for i in range(values.shape[0]) for j in range(values.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, value double")


# ---- sums under the learners --------------------------------------------------------------------

_CELLS = "SELECT category, row_id, CAST(unnest(range(64)) AS INT) AS i, unnest(features) AS v FROM matrix"


@query("covariance_matrix", oracle(f"""
SELECT a.i, b.i AS j, {round_sql('covar_samp(a.v, b.v)', 'value')}
FROM ({_CELLS}) a JOIN ({_CELLS}) b USING (row_id) GROUP BY a.i, b.i""", "matrix"))
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long_matrix(spark, sums.moments(matrix(spark, sf_dir))[2]), ["value"])


@query("class_means", oracle(f"""
SELECT category AS i, i AS j, {round_sql('avg(v)', 'value')} FROM ({_CELLS}) c GROUP BY category, i""", "matrix"))
def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, means, _ = sums.class_scatter(matrix(spark, sf_dir), "category", list(range(10)))
    return rounded(_long_matrix(spark, means), ["value"])


@query("within_scatter", oracle(f"""
SELECT i, j, {round_sql('sum(s)', 'value')} FROM (
  SELECT a.category, a.i, b.i AS j, covar_pop(a.v, b.v) * count(*) AS s
  FROM ({_CELLS}) a JOIN ({_CELLS}) b USING (row_id) GROUP BY a.category, a.i, b.i) c GROUP BY i, j""", "matrix"))
def within_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, within = sums.class_scatter(matrix(spark, sf_dir), "category", list(range(10)))
    return rounded(_long_matrix(spark, within), ["value"])


_LANDMARKS = 12
_LANDMARK_ORDER = "(row_id * 2654435761) % 4294967296"


@query("landmark_distances", oracle(f"""
SELECT x.row_id, l.row_id AS landmark, {round_sql('list_sum(list_transform(list_zip(x.features, l.features), '
                                                  'lambda p: (p[1] - p[2]) * (p[1] - p[2])))', 'd2')}
FROM matrix x, (SELECT * FROM matrix ORDER BY {_LANDMARK_ORDER}, row_id LIMIT {_LANDMARKS}) l""", "matrix"))
def landmark_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows against a landmark sample chosen by a hash both engines have."""
    data = matrix(spark, sf_dir)
    chosen = landmarks.choose_landmarks(data, "row_id", _LANDMARKS, F.expr(_LANDMARK_ORDER))
    keys, points = landmarks.fetch(chosen, "row_id", "features")
    names = F.array(*[F.lit(int(k)).cast("long") for k in keys])
    cells = F.arrays_zip(names.alias("landmark"), landmarks.landmark_distances("features", points).alias("d2"))
    return rounded(data.select("row_id", F.inline(cells)), ["d2"])


_NEAREST = oracle(f"""
SELECT row_id, neighbour, CAST(r0 AS INT) AS rank, {round_sql('d2', 'd2')} FROM (
  SELECT x.row_id, y.row_id AS neighbour, d2, row_number() OVER (PARTITION BY x.row_id ORDER BY d2, y.row_id) - 1 AS r0
  FROM matrix x, matrix y, LATERAL (SELECT list_sum(list_transform(list_zip(x.features, y.features),
    lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2) d WHERE x.row_id <> y.row_id) r WHERE r0 < 10""", "matrix")


@query("knn_exact", _NEAREST)
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.exact_knn(matrix(spark, sf_dir), 10), ["d2"])


@query("knn_hashed", _NEAREST)
def knn_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to a bucket of rows nothing is missed; larger tables are held to a recall in the tests."""
    return rounded(hashed.hashed_knn(matrix(spark, sf_dir), 10), ["d2"])


@query("knn_affinity")
def knn_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_affinity(matrix(spark, sf_dir), perplexity=10.0)


# ---- reducers -----------------------------------------------------------------------------------

@query("pca_embed")
def pca_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = matrix(spark, sf_dir)
    model = linear.PcaReducer(2).fit(data.where("split = 'train'"))
    return _split_columns(model.transform(data), "embedding", 2)


@query("lda_embed")
def lda_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = matrix(spark, sf_dir)
    model = linear.LdaReducer(2, categories=True).fit(data.where("split = 'train'"))
    return _split_columns(model.transform(data), "embedding", 2)


def _net_query(name: str, maker):
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = matrix(spark, sf_dir)
        model = _net(maker, reconstruct="mse").fit(data.where("split = 'train'"))
        return _split_columns(model.transform(data), "embedding", 2)

    return run


ae_category = _net_query("ae_category", nets.ae_category)
ae_binary = _net_query("ae_binary", nets.ae_binary)
ae_unsupervised = _net_query("ae_unsupervised", nets.ae_unsupervised)
net_supervised = _net_query("net_supervised", nets.net_supervised)


@query("label_head_predict")
def label_head_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = matrix(spark, sf_dir)
    model = _net(nets.ae_category).fit(data.where("split = 'train'"))
    scored = data.withColumn("scores", model.label_scores())
    return scored.select("row_id", "split", argmax("scores").alias("predicted"), F.array_max("scores").alias("share"))


@query("mds_embed")
def mds_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = matrix(spark, sf_dir)
    return _split_columns(linear.MdsReducer(2).fit(data).transform(data), "embedding", 2)


@query("tsne_embed")
def tsne_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splits, since only fitted rows have a place."""
    data = matrix(spark, sf_dir)
    return _split_columns(tsne.TsneReducer(2).fit(data).transform(data), "embedding", 2)


# two columns have principal axes in closed form
_PLANE = """
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS u, CAST(l_extendedprice AS DOUBLE) / 1000 AS v FROM lineitem),
m AS (SELECT avg(u) AS mu, avg(v) AS mv, var_samp(u) AS a, covar_samp(u, v) AS b, var_samp(v) AS c FROM x),
l AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS top FROM m),
axis AS (SELECT mu, mv, b / sqrt(b * b + pow(top - a, 2)) AS p, (top - a) / sqrt(b * b + pow(top - a, 2)) AS q FROM l),
-- an axis points to where its largest entry is positive
signed AS (SELECT mu, mv, CASE WHEN greatest(abs(p), abs(q)) = abs(p) THEN p * sign(p) ELSE p * sign(q) END AS p,
  CASE WHEN greatest(abs(p), abs(q)) = abs(p) THEN q * sign(p) ELSE q * sign(q) END AS q FROM axis)
"""
_PLANE_SQL = f"""{_PLANE}
SELECT l_orderkey, l_linenumber, {round_sql('(u - mu) * p + (v - mv) * q', 'e0')} FROM x, signed"""


def _two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.array(
        F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double") / 1000).alias("features"))


def _plane(spark: SparkSession, sf_dir: str, reducer) -> DataFrame:
    data = _two_columns(spark, sf_dir)
    placed = reducer.fit(data).transform(data)
    return rounded(placed.select("l_orderkey", "l_linenumber", F.get("embedding", F.lit(0)).alias("e0")), ["e0"])


@query("pca_plane", _PLANE_SQL)
def pca_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir, linear.PcaReducer(1))


@query("mds_plane", _PLANE_SQL)
def mds_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir, linear.MdsReducer(1))


@query("feature_weights_plane", f"""{_PLANE}
SELECT 0 AS run, f.feature, f.dim, {round_sql("CASE f.k WHEN 0 THEN p WHEN 1 THEN q END", "value")}
FROM signed, (SELECT unnest(['f0', 'f1']) AS feature, unnest([0, 1]) AS k, CAST(0 AS INT) AS dim) f""")
def feature_weights_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the first principal axis of two columns."""
    model = linear.PcaReducer(1).fit(_two_columns(spark, sf_dir))
    return rounded(model.weights(spark).where("dim = 0"), ["value"])


_THIRDS = "CASE WHEN l_orderkey % 5 = 0 THEN 'test' WHEN l_orderkey % 5 = 1 THEN 'val' ELSE 'train' END"


@query("embedding_store_plane", f"""{_PLANE}
SELECT l_orderkey * 8 + l_linenumber AS row_id, {_THIRDS} AS split, {round_sql('(u - mu) * p + (v - mv) * q', 'e0')} FROM x, signed""")
def embedding_store_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all rows, written and read back split by split."""
    data = _two_columns(spark, sf_dir).select(
        F.expr("l_orderkey * 8 + l_linenumber").alias("row_id"), F.expr(_THIRDS).alias("split"), "features")
    path = work_path(spark, "embeddings")
    stores.save_embeddings(linear.MdsReducer(1).fit(data).transform(data), path)
    parts = [stores.load_embeddings(spark, path, split) for split in ("train", "val", "test")]
    return rounded(_split_columns(reduce(DataFrame.unionByName, parts), "embedding", 1), ["e0"])


# ---- classifiers and experiments ------------------------------------------------------------------

def _vectors(spark: SparkSession, sf_dir: str, label: str = "label") -> DataFrame:
    return _with_folds(matrix(spark, sf_dir), label)


def _with_folds(data: DataFrame, label: str) -> DataFrame:
    return data.select(
        "row_id", "split", array_to_vector("features").alias("vec"), F.col(label).cast("double").alias("y"),
        learners.fold_column("row_id", label).alias(learners.FOLD))


def _predicted(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("row_id", "split", F.col("y").cast("int").alias("truth"),
                                        F.col("prediction").cast("int").alias("prediction"))


@query("decision_tree")
def decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _predicted(learners.decision_tree("y").fit(rows.where("split = 'train'")), rows)


@query("decision_tree_gridsearch")
def decision_tree_gridsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _predicted(learners.decision_tree_gridsearch("y").fit(rows.where("split = 'train'")), rows)


@query("best_params")
def best_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    model = learners.decision_tree_gridsearch("y").fit(rows.where("split = 'train'"))
    return learners.best_params(learners.search_table(model, spark))


@query("linear_svc_gridsearch")
def linear_svc_gridsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return _predicted(learners.linear_svc_gridsearch("y").fit(rows.where("split = 'train'")), rows)


@query("logistic_gridsearch")
def logistic_gridsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    train = written(rows.where("split = 'train'"), "train")
    return _predicted(learners.logistic_gridsearch("y", train.count()).fit(train), rows)


@query("kmeans_cluster")
def kmeans_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir, "category")
    return _predicted(learners.kmeans("y").fit(rows.where("split = 'train'")), rows)


@query("compare_spaces")
def compare_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = matrix(spark, sf_dir)
    trial = experiment.Experiment(linear.PcaReducer(2))
    return trial.fit(data).scores(data)


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a class that follows from the month, the only feature that varies; a principal axis keeps it whole."""
    month = F.month("o_orderdate")
    category = F.least(month, F.lit(10)) - 1
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("row_id"), F.array(month.cast("double"), F.lit(0.0)).alias("features"),
        category.alias("category"), (category != 9).cast("int").alias("label"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'test' WHEN o_orderkey % 5 = 1 THEN 'val' ELSE 'train' END").alias("split"))


SEASONS = """WITH seasons AS (SELECT o_orderkey AS row_id, CAST(least(month(o_orderdate), 10) - 1 AS INT) AS category,
  CASE WHEN o_orderkey % 5 = 0 THEN 'test' WHEN o_orderkey % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM orders)"""
_AVERAGES = ", ".join(f"'{m}'" for m in classification.AVERAGES)


@query("compare_spaces_rule", f"""{SEASONS},
found AS (SELECT DISTINCT split, category FROM seasons),
metrics AS (SELECT 'binary' AS task, split, unnest(['accuracy', 'precision', 'recall', 'f1', 'far']) AS metric FROM (SELECT DISTINCT split FROM found)
  UNION ALL SELECT 'category', split, unnest([{_AVERAGES}]) FROM (SELECT DISTINCT split FROM found)
  UNION ALL SELECT 'category', split, m || '_' || category FROM found, (SELECT unnest(['f1', 'precision', 'recall']) AS m))
SELECT 0 AS run, 'Decision Tree' AS classifier, task, space, split, metric, CASE WHEN metric = 'far' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value
FROM metrics, (SELECT unnest(['original', 'reduced']) AS space)""")
def compare_spaces_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison, grid searches included, where the classes follow from a feature: no tree may err."""
    data = written(seasons(spark, sf_dir), "seasons")
    trial = experiment.Experiment(linear.PcaReducer(1))
    return rounded(trial.fit(data).scores(data), ["value"])


@query("tree_search_rule", f"{SEASONS} SELECT row_id, split, category AS truth, category AS prediction FROM seasons")
def tree_search_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(_with_folds(seasons(spark, sf_dir), "category"), "seasons")
    return _predicted(learners.decision_tree_gridsearch("y").fit(rows.where("split = 'train'")), rows)


@query("tree_rule", f"{SEASONS} SELECT row_id, split, category AS truth, category AS prediction FROM seasons")
def tree_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_folds(seasons(spark, sf_dir), "category")
    return _predicted(learners.decision_tree("y").fit(rows.where("split = 'train'")), rows)


@query("logistic_rule", f"{SEASONS} SELECT row_id, split, CAST(category <> 9 AS INT) AS truth, CAST(category <> 9 AS INT) AS prediction FROM seasons")
def logistic_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(_with_folds(seasons(spark, sf_dir), "label"), "seasons")
    train = rows.where("split = 'train'")
    return _predicted(learners.built(learners.REGISTRY["Logistic Regression"], "y", train).fit(train), rows)


@query("linear_svc_rule", f"{SEASONS} SELECT row_id, split, CAST(category <> 9 AS INT) AS truth, CAST(category <> 9 AS INT) AS prediction FROM seasons")
def linear_svc_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search where a threshold on one feature parts the classes."""
    rows = written(_with_folds(seasons(spark, sf_dir), "label"), "seasons")
    train = rows.where("split = 'train'")
    return _predicted(learners.built(learners.REGISTRY["SVM"], "y", train).fit(train), rows)


@query("compare_spaces_clustering")
def compare_spaces_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = matrix(spark, sf_dir)
    trial = experiment.Experiment(linear.PcaReducer(2), 1, {}, learners.CLUSTERERS)
    return trial.fit(data).scores(data)


@query("ensemble_runs")
def ensemble_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independently initialised runs, scored by their own label head, as mean and deviation."""
    data = matrix(spark, sf_dir)
    trial = experiment.Experiment(_net(nets.ae_category)).fit(data)
    return reports.run_mean_std(trial.own_scores(data))


@query("feature_weights")
def feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.PcaReducer(2).fit(matrix(spark, sf_dir).where("split = 'train'")).weights(spark)


@query("weights_report")
def weights_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every latent dimension: features down, (model, parameter, run) across."""
    data = matrix(spark, sf_dir)
    frames = []
    for name, maker in (("bin_ae", nets.ae_binary), ("cats_ae", nets.ae_category)):
        trial = experiment.Experiment(_net(maker, reconstruct="mse")).fit(data)
        frames.append(trial.weights(spark).withColumns({"model": F.lit(name), "param": F.lit("0.1")}))
    tables = stores.weights_report(frames[0].unionByName(frames[1]))
    return reduce(DataFrame.unionByName, [table.select(F.lit(d).alias("dim"), "*") for d, table in tables.items()])


@query("model_registry", "SELECT CAST(unnest([0, 1]) AS INT) AS run, count(*) AS rows, true AS same FROM embeddings")
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit and save, load instead of training the second time, and compare the embeddings of both."""
    data = matrix(spark, sf_dir)
    path = work_path(spark, "models")
    trial = experiment.Experiment(_net(nets.ae_category), _REGISTRY_RUNS)
    fitted = trial.fit_or_load(data, path).models
    loaded = experiment.Experiment(_net(nets.ae_category), _REGISTRY_RUNS).fit_or_load(data, path).models
    frames = [
        data.select(F.lit(run).alias("run"), "row_id", (a.embedding() == b.embedding()).alias("same"))
        for run, (a, b) in enumerate(zip(fitted, loaded))
    ]
    return frames[0].unionByName(frames[1]).groupBy("run").agg(
        F.count("*").alias("rows"), F.bool_and("same").alias("same"))


@query("embedding_store")
def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a map that cannot be recomputed cheaply, written and read back by split."""
    data = matrix(spark, sf_dir)
    path = work_path(spark, "embeddings")
    stores.save_embeddings(linear.MdsReducer(2).fit(data).transform(data), path)
    parts = [stores.load_embeddings(spark, path, split) for split in ("train", "val", "test")]
    return _split_columns(reduce(DataFrame.unionByName, parts), "embedding", 2)
