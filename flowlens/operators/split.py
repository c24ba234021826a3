"""Splits, unions of splits, contiguous indexes and slices by index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import written


def hash_bucket(key: str, seed: int = 1337, buckets: int = 100) -> Column:
    """Stable pseudo-random bucket of a row, independent of partitioning and row order."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))


def random_split(df: DataFrame, bucket: Column, val_percent: int = 20, column: str = "split") -> DataFrame:
    """Mark ``val_percent`` of the rows ``val`` and the rest ``train``; ``bucket`` is uniform on 0..99."""
    return df.withColumn(column, F.when(bucket < val_percent, "val").otherwise("train"))


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Stack tables under a ``split`` column, from which every slice can be recovered."""
    return reduce(DataFrame.unionByName, [df.withColumn("split", F.lit(name)) for name, df in splits.items()])


def assign_index(df: DataFrame, order: list[str], column: str = "index", partitions: int | None = None) -> DataFrame:
    """Contiguous 0..n-1 in ``order`` without a one-partition sort.

    Rows are range-partitioned, sorted and written once with their partition and position, so the two passes
    (rows per partition, then offsets) agree. ``order`` must be unique.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    numbered = written(
        ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "index"
    )
    in_part = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))

    # one row per partition: a running sum over these is small by construction
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col("_offset") + in_part)
        .drop("_part", "_row", "_n", "_offset")
    )


def positional_slices(df: DataFrame, index: str, head: int, row: int, tail: int) -> DataFrame:
    """First ``head`` rows, the row at ``row`` and the rows from ``tail`` on, tagged in one scan."""
    i = F.col(index)
    tags = F.array(
        F.when(i < head, F.lit("head")), F.when(i == row, F.lit("row")), F.when(i >= tail, F.lit("tail"))
    )
    return df.where((i < head) | (i == row) | (i >= tail)).withColumn("slice", F.explode(F.array_compact(tags)))
