"""Sinks written once per micro-batch: a repeated batch overwrites its own folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.session import work_path


def epoch_path(path: str, epoch: int) -> str:
    return f"{path}/epoch={epoch}"


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(epoch_path(path, epoch))


def drop_epoch(spark: SparkSession, path: str, epoch: int) -> None:
    """Remove a superseded epoch written by the same stream."""
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(epoch_path(path, epoch))
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def write_newest(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer for complete results: the newest epoch counts, older ones are removed."""

    def write(batch: DataFrame, epoch: int) -> None:
        write_epoch(batch, path, epoch)
        if epoch >= keep:
            drop_epoch(batch.sparkSession, path, epoch - keep)

    return write


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """All epochs, with their number."""
    return spark.read.option("basePath", path).parquet(f"{path}/epoch=*")


def latest_epoch(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    epochs = [int(s.getPath().getName().split("=")[1]) for s in listed if s.getPath().getName().startswith("epoch=")]
    return spark.read.parquet(epoch_path(path, max(epochs)))


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append",
          checkpoint: str | None = None, state_partitions: int | None = None) -> None:
    """Run a stream over everything available and stop."""
    query = start(stream, each, mode, checkpoint, available_now=True, state_partitions=state_partitions)
    query.awaitTermination()


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append",
          checkpoint: str | None = None, available_now: bool = False, every: str = "200 milliseconds",
          state_partitions: int | None = None) -> StreamingQuery:
    """``state_partitions``: stores that a new checkpoint deals its state over, each opened and written in every batch."""
    checkpoint = checkpoint or work_path(stream.sparkSession, "stream-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    key, conf = "spark.sql.shuffle.partitions", stream.sparkSession.conf
    before = conf.get(key)
    if state_partitions:
        conf.set(key, str(min(state_partitions, int(before))))
    try:
        return writer.start()  # the query keeps the settings it starts with
    finally:
        if state_partitions:
            conf.set(key, before)


def last_value_per_key(epochs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Result of an update-mode stream: the newest row of every key."""
    return epochs.groupBy(*keys).agg(F.max_by(value, "epoch").alias(value))

