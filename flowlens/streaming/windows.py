"""The last N flows of a stream and its confusion matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.operators.classification import category_confusion
from flowlens.streaming import sinks


def keep_last_n(path: str, n: int, index: str, category: str, predictions: list[str]):
    """foreachBatch writer: the last ``n`` flows of the batch and of the window before, as ``path/window``.

    Every task keeps its own last n rows before they meet, so a batch of any size moves n rows a task at most. There is no
    state besides the window of the epoch before, which a repeat of the batch reads again; older windows are removed.
    """
    ints = [category, *predictions]

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(index).cast("long").alias(index), *[F.col(c).cast("int").alias(c) for c in ints])
        if epoch > 0:
            rows = rows.unionByName(spark.read.parquet(sinks.epoch_path(f"{path}/window", epoch - 1)))
        sinks.write_epoch(rows.orderBy(F.desc(index)).limit(n), f"{path}/window", epoch)
        if epoch >= 2:
            sinks.drop_epoch(spark, f"{path}/window", epoch - 2)

    return write


def long_predictions(df: DataFrame, predictions: list[str]) -> DataFrame:
    """One row per flow and predictor: category, predictor, pred."""
    cells = [F.struct(F.lit(p).alias("predictor"), F.col(p).cast("int").alias("pred")) for p in predictions]
    return df.select("*", F.inline(F.array(*cells)))


def confusion_stream(stream: DataFrame, category: str, predictions: list[str]) -> DataFrame:
    """Counts of the whole stream so far per predictor, category and verdict: at most a few dozen rows of state,
    so complete mode suits it."""
    return long_predictions(stream.select(F.col(category).alias("category"), *predictions), predictions).groupBy(
        "predictor", "category", "pred").agg(F.count("*").alias("n"))


def windowed_confusion_stream(stream: DataFrame, time: str, category: str, predictions: list[str],
                              width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """The same per event-time window; flows later than the watermark are dropped from closed windows."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    long = long_predictions(timed.select("_time", F.col(category).alias("category"), *predictions), predictions)
    return long.groupBy(F.window("_time", width), "predictor", "category", "pred").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), "predictor", "category", "pred", "n")


def window_confusion(window: DataFrame, category: str, predictions: list[str]) -> DataFrame:
    """The ten-row matrix of each predictor over the last-n window."""
    long = long_predictions(window.select(F.col(category).alias("category"), *predictions), predictions)
    return category_confusion(long, "category", "pred", ["predictor"])


def zero_filled(counts: DataFrame) -> DataFrame:
    """Accumulated counts as the ten-row matrix of each predictor."""
    cells = [
        F.sum(F.when((F.col("category") == c) & (F.col("pred") == v), F.col("n")).otherwise(0)).alias(f"c{c}_{v}")
        for c in range(10) for v in (0, 1)
    ]
    rows = F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"c{c}_0").alias("normal"), F.col(f"c{c}_1").alias("attack"))
        for c in range(10)
    ])
    return counts.groupBy("predictor").agg(*cells).select("predictor", F.inline(rows))
