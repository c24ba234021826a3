"""Parquet stores for embeddings, scored flows, score tables and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.codes import code_columns
from flowlens.operators.scale import ColumnScaler
from flowlens.operators.split import assign_index


def save_embeddings(df: DataFrame, path: str) -> None:
    """(row_id, split, embedding), laid out by split so that one split reads only its files."""
    df.select("row_id", "embedding", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def load_embeddings(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).select("row_id", "split", "embedding")
    return df if split is None else df.where(F.col("split") == split)


SCORED_COLUMNS = (
    "original_pred cats_ae_pred x_cats_ae y_cats_ae label category cat_str cats_ae_pred_str original_pred_str index"
).split()


def scored_flows(df: DataFrame, train: DataFrame, order: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The ten-column scored-flow table and the scaled training points.

    ``df`` has row_id, x, y, label, category and the two predictions; ``train`` has x, y, category. Both
    maps are scaled by their joint minimum and maximum.
    """
    scaler = ColumnScaler.fit_joint([df, train], ["x", "y"])
    scored = assign_index(df, [order]).select(
        scaler.column("x").alias("x_cats_ae"), scaler.column("y").alias("y_cats_ae"),
        F.col("label").cast("double").alias("label"), F.col("category").cast("int").alias("category"),
        F.col("category").cast("int").cast("string").alias("cat_str"), F.col("index").cast("long").alias("index"),
        *[c.alias(n) for n, c in code_columns(["cats_ae_pred", "original_pred"]).items()],
    )
    points = train.select(
        scaler.column("x").alias("x"), scaler.column("y").alias("y"), F.col("category").cast("int").alias("category")
    )
    return scored.select(*SCORED_COLUMNS), points


def write_scored_flows(scored: DataFrame, points: DataFrame, path: str) -> None:
    """``flows`` in index order (the replay order) and ``train_points``."""
    scored.write.mode("overwrite").parquet(f"{path}/flows")
    points.write.mode("overwrite").parquet(f"{path}/train_points")


def sort_points_by_category(points: DataFrame) -> DataFrame:
    """Draw order of the background points."""
    return points.orderBy("category")


def weights_report(weights: DataFrame) -> dict[int, DataFrame]:
    """One wide table per latent dimension: a row per feature, a column per (model, param, run)."""
    runs = [r.run for r in weights.select(_run_name().alias("run")).distinct().orderBy("run").collect()]
    dims = [r.dim for r in weights.select("dim").distinct().orderBy("dim").collect()]
    named = weights.withColumn("run_name", _run_name())
    return {
        d: named.where(F.col("dim") == d).groupBy("feature").pivot("run_name", runs).agg(F.first("value"))
        for d in dims
    }


def _run_name():
    return F.concat_ws("_", "model", "param", F.col("run").cast("string"))


def write_weights_report(weights: DataFrame, path: str) -> None:
    """One CSV folder per latent dimension."""
    for dim, table in weights_report(weights).items():
        table.orderBy("feature").write.mode("overwrite").option("header", True).csv(f"{path}/dim={dim}")
