"""Reducers: ML estimators that turn a feature array into a short embedding."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.session import path_exists

PARAM_SCHEMA = "run_id int, param string, i int, j int, value double"


class Reducer(Estimator):
    """``fit`` returns a model whose ``transform`` adds the embedding; usable as a pipeline stage."""

    name = "reducer"

    def __init__(self, size: int = 2, features: str = "features", output: str = "embedding"):
        super().__init__()
        self.size, self.features, self.output = size, features, output

    def identity(self) -> dict:
        """What a saved model must agree in to stand for this reducer."""
        return {"kind": self.name, "size": self.size}

    def with_run(self, run: int) -> Reducer:
        """The same reducer for another independently initialised run."""
        return self


class ReducerModel(Model):
    """A fitted reducer: a few small arrays plus a description."""

    def __init__(self, kind: str, params: dict[str, np.ndarray], features: str = "features",
                 output: str = "embedding", meta: dict | None = None):
        super().__init__()
        self.kind, self.params_, self.features, self.output, self.meta = kind, params, features, output, meta or {}

    def embedding(self) -> Column:
        raise NotImplementedError

    def feature_matrix(self) -> np.ndarray:
        """d x dims weights of the original features."""
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.output, self.embedding())

    def weights(self, spark: SparkSession, names: list[str] | None = None, run: int = 0) -> DataFrame:
        """(run, feature, dim, value)."""
        matrix = self.feature_matrix()
        names = names or [f"f{i}" for i in range(matrix.shape[0])]
        rows = [(run, names[i], j, float(matrix[i, j])) for i in range(matrix.shape[0]) for j in range(matrix.shape[1])]
        return spark.createDataFrame(rows, "run int, feature string, dim int, value double")


def save_models(spark: SparkSession, models: list[ReducerModel], path: str) -> None:
    """Parameters of every run as one long Parquet table, partitioned by run."""
    rows, specs = [], []
    for run, model in enumerate(models):
        specs.append((run, model.kind, model.features, model.output, json.dumps(model.meta)))
        for name, array in model.params_.items():
            grid = np.atleast_2d(array)
            rows += [(run, name, i, j, float(grid[i, j])) for i in range(grid.shape[0]) for j in range(grid.shape[1])]
    spark.createDataFrame(rows, PARAM_SCHEMA).write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/params")
    schema = "run_id int, kind string, features string, output string, meta string"
    spark.createDataFrame(specs, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/runs")


def load_models(spark: SparkSession, path: str) -> list[ReducerModel]:
    from flowlens.reduce import model_class

    table = spark.read.schema(PARAM_SCHEMA).parquet(f"{path}/params")
    out = []
    for spec in spark.read.parquet(f"{path}/runs").orderBy("run_id").collect():
        cells = table.where(F.col("run_id") == spec.run_id).toPandas()
        params = {}
        for name, part in cells.groupby("param"):
            grid = np.zeros((part.i.max() + 1, part.j.max() + 1))
            grid[part.i, part.j] = part.value
            params[name] = grid if spec.meta is None or name not in json.loads(spec.meta).get("flat", []) else grid[0]
        out.append(model_class(spec.kind)(spec.kind, params, spec.features, spec.output, json.loads(spec.meta)))
    return out


def models_exist(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/runs/_SUCCESS") and path_exists(spark, f"{path}/params/_SUCCESS")
