"""Compare classifiers and clusterers on original and reduced features, over repeated runs."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.vectors import argmax, one_hot_of, threshold
from flowlens.operators import classification as cls, clustering as clu, scores as reports
from flowlens.reduce import learners
from flowlens.reduce.base import Reducer, ReducerModel, load_models, models_exist, save_models
from flowlens.schema import CATEGORIES
from flowlens.session import written

NET_RUNS = 5  # fixed value
TASKS = {"binary": "label", "category": "category"}
_LONG = ["run", "classifier", "task", "space", "split", "metric", "value"]


def compare_spaces(data: DataFrame, space: str, run: int, classifiers: dict[str, learners.Factory],
                   features: str, key: str = "row_id", searches: list[tuple] | None = None) -> DataFrame:
    """Fit every classifier on the train split for both tasks and score all splits, as a long table.

    ``data`` has row_id, label, category, split and the array column ``features``. ``searches`` gets a row
    (run, classifier, task, space, params, accuracy) for each grid search: its best point.
    """
    out = []
    vectors = written(data.withColumn("vec", array_to_vector(F.col(features))).select(key, "split", "vec", *TASKS.values()), "vectors")
    for name, factory in classifiers.items():
        for task, label in TASKS.items():
            rows = vectors.withColumn(learners.FOLD, learners.fold_column(key, label)).select(
                key, "split", "vec", learners.FOLD, F.col(label).cast("double").alias("y"))
            train = rows.where("split = 'train'")
            model = learners.built(factory, "y", train).fit(train)
            if searches is not None and hasattr(model, "avgMetrics"):
                searches.append((run, name, task, space, *learners.best_point(model)))
            predicted = model.transform(rows).select("split", "y", "prediction")
            metrics = cls.binary_scores if task == "binary" else cls.category_scores
            out.append(_labelled(metrics(predicted, "y", "prediction", ["split"]), run, name, task, space))
    return _stack(out)


def compare_spaces_clustering(data: DataFrame, space: str, run: int, clusterers: dict[str, learners.Factory],
                              features: str, key: str = "row_id") -> DataFrame:
    """The same for clusterers: agreement with either label, plus silhouette and dispersion per split."""
    out = []
    vectors = data.withColumn("vec", array_to_vector(F.col(features)))
    for name, factory in clusterers.items():
        model = factory("label").fit(vectors.where("split = 'train'"))
        placed = model.transform(vectors).select(key, "split", "label", "category", features, "prediction")
        placed = written(placed, "placed")
        # small tables, each written by a plan of its own
        shapes = written(_shapes(placed, features, key), "shapes")
        for task, label in TASKS.items():
            table = clu.agreement_metrics(placed, label, "prediction", ["split"]).join(shapes, "split")
            names = ["adj_rand_index", "adj_mutual_info", "homogeneity", "completeness", "v-measure",
                     "fowlkes-mallows", "silhouette", "calinski-harabasz"]
            out.append(written(_labelled(cls.long_metrics(table, ["split"], names), run, name, task, space), "scores"))
    return _stack(out)


def _shapes(placed: DataFrame, features: str, key: str) -> DataFrame:
    parts = []
    for split in ("train", "val", "test"):
        rows = placed.where(F.col("split") == split)
        silhouette = clu.silhouette(rows, features, "prediction", key).withColumn("split", F.lit(split))
        dispersion = clu.calinski_harabasz(rows, features, "prediction").withColumn("split", F.lit(split))
        parts.append(silhouette.join(dispersion.withColumnRenamed("calinski_harabasz", "calinski-harabasz"), "split"))
    return _stack(parts)


def _labelled(metrics: DataFrame, run: int, classifier: str, task: str, space: str) -> DataFrame:
    return metrics.withColumns({
        "run": F.lit(run), "classifier": F.lit(classifier), "task": F.lit(task), "space": F.lit(space),
    }).select(*_LONG)


def _stack(frames: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, frames)


def own_scores(data: DataFrame, model, run: int, key: str = "row_id") -> DataFrame:
    """Scores of a net's own label head. Category heads are judged on indicator rows, binary ones after rounding.
    There is no original-space value, so none is emitted."""
    head = model.meta["spec"]["head"]
    scored = data.select("split", "label", "category", model.label_scores().alias("scores"))
    if head == "category":
        width = len(CATEGORIES)
        rows = scored.select("split", one_hot_of(F.col("category"), width).alias("t"),
                             one_hot_of(argmax("scores"), width).alias("p"))
        metrics, task = cls.indicator_scores(rows, "t", "p", width, ["split"]), "category"
    else:
        rows = scored.select("split", F.col("label").alias("t"), threshold(F.get("scores", F.lit(0))).alias("p"))
        metrics, task = cls.binary_scores(rows, "t", "p", ["split"]), "binary"
    return _labelled(metrics, run, "own", task, "reduced")


class Experiment:
    """``runs`` fits of one reducer, their scores and reports.

    ``data`` is a table with row_id, features, label, category and split. Scores on the original features
    are the same for every run, so they are computed once. By default networks, which start at random, have five runs,
    other reducers one. ``searches`` holds the best point of every grid search after ``scores``.
    """

    def __init__(self, reducer: Reducer, runs: int | None = None, classifiers: dict[str, learners.Factory] | None = None,
                 clusterers: dict[str, learners.Factory] | None = None):
        self.reducer, self.runs = reducer, runs or (NET_RUNS if hasattr(reducer, "fit_runs") else 1)
        self.searches: list[tuple] = []
        self.classifiers = learners.CLASSIFIERS if classifiers is None else classifiers
        self.clusterers = {} if clusterers is None else clusterers
        self.models: list[ReducerModel] = []

    def fit(self, data: DataFrame) -> Experiment:
        """Networks train all runs in the same passes; other reducers fit run by run. Maps without a formula see all splits."""
        train = data if self.reducer.name in ("mds", "tsne") else data.where("split = 'train'")
        if hasattr(self.reducer, "fit_runs"):
            self.models = self.reducer.fit_runs(train, self.runs)
        else:
            self.models = [self.reducer.with_run(r).fit(train) for r in range(self.runs)]
        return self

    def fit_or_load(self, data: DataFrame, path: str | None) -> Experiment:
        """Skip training when the path already holds models."""
        spark = data.sparkSession
        if path and models_exist(spark, path):
            return self.load(spark, path)
        self.fit(data)
        if path:
            self.save(spark, path)
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        save_models(spark, self.models, path)

    def load(self, spark: SparkSession, path: str, settings: bool = True) -> Experiment:
        """Raises unless the path holds as many runs of the same kind, size and, if wanted, settings as asked for."""
        models = load_models(spark, path)
        asked = {k: v for k, v in self.reducer.identity().items() if settings or k in ("kind", "size")}
        for model in models:
            found = {"kind": model.kind, **{k: v for k, v in model.meta.items() if k in asked}}
            found["size"] = model.meta.get("requested", model.meta.get("size"))
            if found != asked:
                raise ValueError(f"{path} holds {found}, not {asked}")
        if len(models) != self.runs:
            raise ValueError(f"{path} holds {len(models)} runs, not {self.runs}")
        self.models = models
        return self

    def scores(self, data: DataFrame) -> DataFrame:
        """Long score table. The original space is scored once and repeated for every run."""
        runs = F.array(*[F.lit(i) for i in range(len(self.models))])
        original = self._space(data, "original", 0, self.reducer.features).drop("run").withColumn("run", F.explode(runs))
        reduced = [
            self._space(model.transform(data), "reduced", run, self.reducer.output)
            for run, model in enumerate(self.models)
        ]
        return _stack([original.select(*_LONG), *reduced])

    def _space(self, data: DataFrame, space: str, run: int, features: str) -> DataFrame:
        out = []
        if self.classifiers:
            out.append(compare_spaces(data, space, run, self.classifiers, features, searches=self.searches))
        if self.clusterers:
            out.append(compare_spaces_clustering(data, space, run, self.clusterers, features))
        return _stack(out)

    def best_parameters(self, spark: SparkSession) -> DataFrame:
        """(run, classifier, task, space, params, accuracy) of every search so far."""
        return spark.createDataFrame(
            self.searches, "run int, classifier string, task string, space string, params string, accuracy double")

    def own_scores(self, data: DataFrame) -> DataFrame:
        return _stack([own_scores(data, model, run) for run, model in enumerate(self.models)])

    def weights(self, spark: SparkSession, names: list[str] | None = None) -> DataFrame:
        return _stack([model.weights(spark, names, run) for run, model in enumerate(self.models)])

    @staticmethod
    def mean(scores: DataFrame) -> DataFrame:
        return reports.run_aggregate(scores, F.avg)

    @staticmethod
    def std(scores: DataFrame) -> DataFrame:
        return reports.run_aggregate(scores, F.stddev_pop)
