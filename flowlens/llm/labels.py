"""Which labelled documents may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def held_out(parts: int) -> Column:
    """Documents of the part that nothing is learned from: crc32 of doc_id as text leaves no remainder. Null: not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == 0, F.lit(False))


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """Of each label ``y`` (0 or 1) at most ``most`` rows, the first by a hash of doc_id, with their ``place`` from 0 on.

    A threshold on the hash leaves about twice as many first, so that no label comes together whole in the window.
    """
    share = (F.xxhash64("doc_id").bitwiseAND(0x7FFFFFFF)) / F.lit(float(2**31))
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    near = F.lit(False)
    for y, n in counts.items():
        near = near | ((F.col("y") == y) & (share < min(1.0, 2.0 * most / n)))
    order = Window.partitionBy("y").orderBy(share, "doc_id")
    return rows.where(near).withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < most)
