"""The long score table (run, classifier, task, space, split, metric, value) and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.schema import SCORE_COLUMNS

KEYS = ["classifier", "task", "space", "split", "metric"]


def run_aggregate(scores: DataFrame, op, name: str = "value") -> DataFrame:
    """Fold every metric over the runs. ``op`` maps the value column to an aggregate: a built-in
    (``F.avg``) or a grouped-aggregate pandas UDF."""
    return scores.groupBy(*KEYS).agg(op(F.col("value")).alias(name))


def run_mean_std(scores: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the runs."""
    return scores.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _slot() -> Column:
    """Report column of a row: space, with the split appended unless it is the test split."""
    return F.when(F.col("split") == "test", F.col("space")).otherwise(F.concat_ws("_", "space", "split"))


def score_table_wide(scores: DataFrame, value: str = "value", by: tuple[str, ...] = ("classifier", "task")) -> DataFrame:
    """metric x (original, reduced) x (test, val, train), as one row per metric."""
    return (
        scores.withColumn("_slot", _slot())
        .groupBy(*by, "metric").pivot("_slot", SCORE_COLUMNS).agg(F.first(value))
    )


def sort_metrics(scores: DataFrame) -> DataFrame:
    return scores.orderBy("metric")


def score_report(scores: DataFrame) -> dict[str, DataFrame]:
    """Report tables by task (binary and category), ordered by classifier and metric name."""
    wide = score_table_wide(scores)
    return {
        task: wide.where(F.col("task") == task).drop("task").orderBy("classifier", "metric")
        for task in ("binary", "category")
    }
