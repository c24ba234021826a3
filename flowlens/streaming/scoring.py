"""Scoring and explaining flows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from flowlens.operators.neighbours import EpsNeighbourModel
from flowlens.reduce.base import ReducerModel
from flowlens.reduce.learners import decision_tree
from flowlens.streaming import sinks


class FlowScorer:
    """Embedding and the two Normal/Attack predictions of a flow: a stateless projection, batch or stream.

    One default tree reads the embedding, one the original features.
    """

    def __init__(self, reducer: ReducerModel, reduced_tree: DecisionTreeClassificationModel,
                 original_tree: DecisionTreeClassificationModel):
        self.reducer, self.reduced_tree, self.original_tree = reducer, reduced_tree, original_tree

    @classmethod
    def fit(cls, reducer: ReducerModel, train: DataFrame, label: str = "label") -> FlowScorer:
        rows = reducer.transform(train).withColumn("y", F.col(label).cast("double")).persist()
        try:
            trees = [
                decision_tree("y").fit(rows.select("y", array_to_vector(F.col(c)).alias("vec")))
                for c in (reducer.output, reducer.features)
            ]
        finally:
            rows.unpersist()
        return cls(reducer, *trees)

    def transform(self, flows: DataFrame) -> DataFrame:
        """Adds x, y, cats_ae_pred and original_pred."""
        embedded = self.reducer.transform(flows)
        for name, tree, column in (("cats_ae_pred", self.reduced_tree, self.reducer.output),
                                   ("original_pred", self.original_tree, self.reducer.features)):
            embedded = tree.transform(embedded.withColumn("vec", array_to_vector(F.col(column))))
            embedded = embedded.withColumn(name, F.col("prediction").cast("int")).drop(
                "vec", "rawPrediction", "probability", "prediction")
        out = F.col(self.reducer.output)
        return embedded.withColumns({"x": F.get(out, F.lit(0)), "y": F.get(out, F.lit(1))})


def explain_batches(model: EpsNeighbourModel, eps: float, path: str,
                    labels: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: the neighbourhood of every arriving flow among the training points."""

    def write(batch: DataFrame, epoch: int) -> None:
        sinks.write_epoch(model.explain(batch, eps, labels), path, epoch)

    return write
