"""Replay of a scored-flow table as a stream, in index order: every tick brings the next ``per_tick`` flows.

The table is numbered without gaps. A tick is a range of numbers from Spark's rate-per-micro-batch source, so its size and order do
not depend on files, and a checkpoint says how far the replay is. Ticks beyond the end are empty.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.session import names_in, text_of, work_path
from flowlens.streaming import sinks

#: Ticks are broadcast to the table they are joined to: 8 bytes a flow.
MOST_PER_TICK = 1_000_000


def write_replay(df: DataFrame, path: str, index: str = "index", files: int = 8) -> None:
    """Files of consecutive index ranges, sorted, so that a tick reads the row groups of its range only."""
    df.repartitionByRange(files, index).sortWithinPartitions(index).write.mode("overwrite").parquet(path)


def ticks(spark: SparkSession, per_tick: int = 1, seek: int | None = None, index: str = "index") -> DataFrame:
    """A stream of the numbers ``seek``, ``seek`` + 1, ...: ``per_tick`` of them in every micro-batch."""
    if not 1 <= per_tick <= MOST_PER_TICK:
        raise ValueError(f"a tick has 1 to {MOST_PER_TICK} flows")
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_tick).option("numPartitions", 1)
    return source.load().select((F.col("value") + F.lit(seek or 0)).alias(index))


def replay_stream(spark: SparkSession, path: str, per_tick: int = 1, seek: int | None = None,
                  index: str = "index") -> DataFrame:
    """The table as a stream, for operators on streams; ``seek`` starts it at a flow number.

    A tick's numbers are broadcast, so the table is not shuffled, but each tick scans it: ticks should be large. Where a
    function of the tick's flows is enough, ``each_tick`` reads only their row groups.
    """
    table = spark.read.parquet(path)
    return table.join(F.broadcast(ticks(spark, per_tick, seek, index)), index).select(*table.columns)


def each_tick(path: str, each: Callable[[DataFrame, int], None], index: str = "index") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer over ``ticks``: ``each`` gets the flows of the tick, read by their range of numbers."""

    def write(numbers: DataFrame, epoch: int) -> None:
        lo, hi = numbers.agg(F.min(index), F.max(index)).first()
        if lo is not None:
            each(numbers.sparkSession.read.parquet(path).where(F.col(index).between(lo, hi)), epoch)

    return write


def ranged_stream(spark: SparkSession, path: str, per_tick: int = 1, seek: int | None = None,
                  index: str = "index") -> Callable[[int], DataFrame]:
    """``replay_stream`` for ``drain``, which says how many flows have come: a run of a tick reads the row groups behind them only.

    A run that repeats an unfinished tick may bring the next one too, so there are two ticks to read.
    """
    table = spark.read.parquet(path)

    def run(come: int) -> DataFrame:
        lo = (seek or 0) + come
        near = table.where(F.col(index).between(lo, lo + 2 * per_tick - 1))
        return near.join(F.broadcast(ticks(spark, per_tick, seek, index)), index).select(*table.columns)

    return run


def drain(stream: DataFrame | Callable[[int], DataFrame], each: Callable[[DataFrame, int], None], flows: int, per_tick: int,
          mode: str = "append", checkpoint: str | None = None, state_partitions: int | None = None) -> None:
    """Run as many ticks as ``flows`` more flows need, then stop. With a checkpoint a later call goes on behind them.

    ``stream`` may be made anew for each tick, from the number of flows that have come.
    """
    made = stream if callable(stream) else lambda come: stream
    spark = made(0).sparkSession
    checkpoint = checkpoint or work_path(spark, "stream-checkpoint")
    for _ in range(-(-flows // per_tick)):  # the source brings one tick whenever it is asked for what is available
        sinks.drain(made(come(spark, checkpoint)), each, mode, checkpoint, state_partitions)


def come(spark: SparkSession, checkpoint: str) -> int:
    """Flows up to the last finished tick of a checkpoint whose first source is ``ticks``."""
    done = [int(name) for name in names_in(spark, f"{checkpoint}/commits") if name.isdigit()]
    if not done:
        return 0
    source = text_of(spark, f"{checkpoint}/offsets/{max(done)}").splitlines()[2]  # a version, the batch's metadata, its sources
    return int(json.loads(source)["offset"])


class Replay:
    """Play, pause and change the speed of a replay. Resuming continues from the checkpoint."""

    def __init__(self, spark: SparkSession, path: str, each: Callable[[DataFrame, int], None],
                 per_tick: int = 1, every: str = "10 milliseconds", seek: int | None = None, index: str = "index"):
        self.spark, self.path, self.each, self.index = spark, path, each, index
        self.per_tick, self.every, self.seek = per_tick, every, seek
        self.checkpoint = work_path(spark, "replay-checkpoint")
        self.query: StreamingQuery | None = None

    def play(self, every: str | None = None) -> StreamingQuery:
        self.every = every or self.every
        if self.query is None or not self.query.isActive:
            stream = ticks(self.spark, self.per_tick, self.seek, self.index)
            self.query = sinks.start(stream, each_tick(self.path, self.each, self.index), checkpoint=self.checkpoint, every=self.every)
        return self.query

    def pause(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self.query = None

    def jump(self, index: int) -> None:
        """Go to a flow number: a new start of the ticks, so a new checkpoint."""
        self.pause()
        self.seek, self.checkpoint = index, work_path(self.spark, "replay-checkpoint")
