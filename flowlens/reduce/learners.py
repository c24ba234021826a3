"""Classifiers and clusterers compared on original and reduced features.

A factory takes the label column, and the training table too if it has a parameter ``train``, and returns an ML estimator
reading ``vec``; register your own under a name.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.reduce.svm import SquaredHingeSvc, SvmSearch
from flowlens.session import drop_written, shared_path, written

# The searched depths and leaf sizes.
TREE_DEPTHS = [2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 26, 34, 44, 56, 73, 94, 121, 156, 202, 256]
TREE_LEAVES = [2, 3, 4, 5, 6, 7, 9, 12, 15, 19, 24, 31, 40, 50, 64]
C_GRID = [10 ** (-6 + 12 * i / 19) for i in range(20)]  # 20 values from 1e-6 to 1e6
MAX_DEPTH = 30
#: Rows of a partition while the trees of a search grow.
TREE_ROWS = 2**16
FOLD = "fold"

Factory = Callable[..., Estimator]


def built(factory: Factory, label: str, train: DataFrame) -> Estimator:
    """The estimator of a factory that may ask for the training table."""
    return factory(label, train=train) if "train" in inspect.signature(factory).parameters else factory(label)


def fold_column(key: str = "row_id", label: str = "label", folds: int = 3, seed: int = 1337) -> Column:
    """Cross-validation fold by hash within the label: even in every class up to the hash, and no sort."""
    return F.pmod(F.xxhash64(F.col(label), F.col(key), F.lit(seed)), F.lit(folds)).cast("int")


def decision_tree(label: str) -> Estimator:
    return DecisionTreeClassifier(labelCol=label, featuresCol="vec", maxDepth=MAX_DEPTH, maxBins=128, seed=0)


def _search(estimator: Estimator, grid: list, label: str, folds: int, parallelism: int) -> CrossValidator:
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds,
                          foldCol=FOLD, parallelism=parallelism)


class TreeSearch(CrossValidator):
    """Grid over ``maxDepth`` and ``minInstancesPerNode`` of a tree, with one fit for each leaf size and fold.

    A greedy tree of a smaller depth is the top of a deeper one of the same leaf size, so only the deepest one is grown;
    the rows of the fold are counted by leaf and class, and a leaf votes at every depth like its ancestor there. Equal
    to a fit for each point. Spark trees end at depth ``MAX_DEPTH``: deeper points are judged on that tree, which is the
    same one wherever growing ended earlier. The counts that reach the driver have a row for each leaf and class of a
    model that lives there anyway.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        tree, points = self.getEstimator(), self.getEstimatorParamMaps()
        leaves = sorted({p[tree.minInstancesPerNode] for p in points})
        depths = sorted({min(p[tree.maxDepth], MAX_DEPTH) for p in points})
        label, fold = tree.getLabelCol(), self.getFoldCol()
        rows = written(dataset.select(tree.getFeaturesCol(), label, fold), "search")
        # every partition sends the statistics of all open nodes, so the trees that grow side by side have few; the last one grows alone
        few = rows.coalesce(max(1, -(-rows.count() // TREE_ROWS)))
        deepest = tree.copy({tree.maxDepth: depths[-1]})
        work = [(leaf, k) for leaf in leaves for k in range(self.getNumFolds())]

        def judge(of: tuple[int, int]) -> np.ndarray | None:
            leaf, k = of
            model = deepest.copy({deepest.minInstancesPerNode: leaf}).fit(few.where(F.col(fold) != k))
            return depth_accuracy(model, rows.where(F.col(fold) == k), label, depths)

        with ThreadPoolExecutor(self.getParallelism()) as pool:
            found = dict(zip(work, pool.map(judge, work)))
        means = {}
        for leaf in leaves:
            judged = [a for k in range(self.getNumFolds()) if (a := found[leaf, k]) is not None]
            if not judged:
                raise ValueError("no fold has rows to judge on")
            means[leaf] = dict(zip(depths, np.mean(judged, axis=0)))
        accuracy = [float(means[p[tree.minInstancesPerNode]][min(p[tree.maxDepth], MAX_DEPTH)]) for p in points]
        best = points[int(np.argmax(accuracy))]
        model = tree.copy({**best, tree.maxDepth: min(best[tree.maxDepth], MAX_DEPTH)}).fit(rows)
        drop_written(rows)
        return self._copyValues(CrossValidatorModel(model, accuracy))


def depth_votes(model: Model, depths: list[int]) -> np.ndarray:
    """[leaf, depth]: the class that the tree would give the rows of each leaf if it ended at that depth.

    Leaves are numbered from left to right like ``leafCol``; the nodes come from the saved form of the model.
    """
    spark = SparkSession.active()
    with shared_path(spark, "tree") as path:
        model.save(path)
        nodes = {r.id: r for r in spark.read.parquet(f"{path}/data").select("id", "prediction", "leftChild", "rightChild").collect()}
    votes, open_nodes = [], [(0, ())]
    while open_nodes:
        at, above = open_nodes.pop()
        node, path = nodes[at], (*above, nodes[at].prediction)
        if node.leftChild < 0:
            votes.append([path[min(d, len(path) - 1)] for d in depths])
        else:
            open_nodes += [(node.rightChild, path), (node.leftChild, path)]
    return np.array(votes)


def depth_accuracy(model: Model, rows: DataFrame, label: str, depths: list[int]) -> np.ndarray | None:
    """Share of ``rows`` that the tree gets right if it ends at each of the depths; None without rows."""
    counts = model.copy().setLeafCol("leaf").transform(rows).groupBy("leaf", label).count().collect()
    if not counts:
        return None
    votes = depth_votes(model, depths)
    leaf, truth, n = (np.array(c) for c in zip(*counts))
    return ((votes[leaf.astype(int)] == truth[:, None]) * n[:, None]).sum(axis=0) / n.sum()


def decision_tree_gridsearch(label: str, depths=TREE_DEPTHS, leaves=TREE_LEAVES, folds: int = 3,
                             parallelism: int = 8) -> CrossValidator:
    """All points of the grid; see ``TreeSearch``."""
    tree = decision_tree(label)
    grid = [{tree.maxDepth: d, tree.minInstancesPerNode: m} for d in depths for m in leaves]
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return TreeSearch(estimator=tree, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, foldCol=FOLD,
                      parallelism=parallelism)


def logistic_gridsearch(label: str, rows: int, cs=C_GRID, folds: int = 3, parallelism: int = 4) -> CrossValidator:
    """``rows`` turns the penalty C of a summed loss into the weight of a mean loss: 1 / (C n)."""
    model = LogisticRegression(labelCol=label, featuresCol="vec", maxIter=100)
    grid = ParamGridBuilder().addGrid(model.regParam, [1 / (c * rows) for c in cs]).build()
    return _search(model, grid, label, folds, parallelism)


def linear_svc_gridsearch(label: str, cs=C_GRID, classes: int = 2, folds: int = 3) -> CrossValidator:
    """Linear SVM with the squared hinge; with more than two classes one per class against the rest. See ``SvmSearch``."""
    svc = SquaredHingeSvc(labelCol=label, featuresCol="vec", classes=classes)
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return SvmSearch(estimator=svc, estimatorParamMaps=[{svc.C: c} for c in cs], evaluator=evaluator, numFolds=folds, foldCol=FOLD)


def kmeans(label: str, k: int = 8) -> Estimator:
    return KMeans(k=k, featuresCol="vec", predictionCol="prediction", seed=0)


def logistic_regression(label: str, train: DataFrame) -> Estimator:
    return logistic_gridsearch(label, train.count(), C_GRID)


def linear_svm(label: str, train: DataFrame) -> Estimator:
    top = train.agg(F.max(label)).first()[0]
    return linear_svc_gridsearch(label, C_GRID, max(2, int(top or 0) + 1))


#: By default only trees are compared; the others can be asked for by name.
REGISTRY: dict[str, Factory] = {"Decision Tree": decision_tree_gridsearch, "SVM": linear_svm, "Logistic Regression": logistic_regression}
CLASSIFIERS: dict[str, Factory] = {"Decision Tree": decision_tree_gridsearch}
CLUSTERERS: dict[str, Factory] = {"K-Means": kmeans}


def search_points(model: CrossValidatorModel) -> list[tuple[str, float]]:
    """(params, mean accuracy over the folds) of every grid point."""
    return [
        (", ".join(f"{p.name}={_shown(v)}" for p, v in sorted(point.items(), key=lambda kv: kv[0].name)), float(score))
        for point, score in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]


def best_point(model: CrossValidatorModel) -> tuple[str, float]:
    return max(search_points(model), key=lambda p: p[1])  # the first of equal ones


def search_table(model: CrossValidatorModel, spark: SparkSession) -> DataFrame:
    """(point, params, accuracy) of every grid point."""
    rows = [(i, *point) for i, point in enumerate(search_points(model))]
    return spark.createDataFrame(rows, "point int, params string, accuracy double")


def _shown(value) -> str:
    return f"{value:g}" if isinstance(value, float) else str(value)


def best_params(table: DataFrame) -> DataFrame:
    """The point with the highest accuracy, the earlier one on ties."""
    return table.orderBy(F.desc("accuracy"), "point").limit(1)
