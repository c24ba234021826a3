"""Approximate neighbour graph: hash tables of bounded buckets, exact distances inside each bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from flowlens.functions.vectors import matrix_of
from flowlens.operators.landmarks import fast_squared_distances
from flowlens.reduce.sums import moments
from flowlens.session import drop_written, written

BITS = 60
#: Rows that are compared with each other at most, and hash tables.
BUCKET, TABLES = 1024, 8


def sign_codes(df: DataFrame, key: str, features: str, tables: int, seed: int = 0) -> DataFrame:
    """(table, id, x, code): on which sides of ``BITS`` random planes through the mean a row lies, for each table."""
    _, mean, _ = moments(df, features)
    planes = np.random.default_rng(seed).normal(size=(len(mean), tables * BITS))
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    @arrow_udf("array<long>")
    def codes(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], pa.list_(pa.int64()))
        above = ((matrix_of(batch) - mean) @ planes > 0).reshape(len(batch), tables, BITS)
        return pa.array(list((above * weights).sum(axis=2)), pa.list_(pa.int64()))

    rows = df.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("x"))
    return rows.withColumn("codes", codes("x")).select("id", "x", F.posexplode("codes").alias("table", "code"))


def bucketed(coded: DataFrame, bucket: int, step: int = 2) -> DataFrame:
    """Adds ``unit``: the rows of a table that share the leading bits of their code, as many bits as a bucket needs to hold
    ``bucket`` rows at most. Rows that all bits leave together, copies among them, are dealt to several units by their id."""
    open_rows = coded.select("table", "id", "code").withColumn("depth", F.lit(0))
    done = []
    for depth in range(0, BITS + 1, step):
        current = open_rows.withColumns({"depth": F.lit(depth), "place": F.expr(f"shiftrightunsigned(code, {BITS - depth})")})
        full = written(current.groupBy("table", "place").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "full")
        if full.isEmpty() or depth == BITS:
            done.append(current.join(full, ["table", "place"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1))).drop("n"))
            break
        done.append(current.join(full, ["table", "place"], "left_anti").withColumn("parts", F.lit(1)))
        open_rows = written(current.join(full, ["table", "place"], "left_semi").select("table", "id", "code"), "open")
    stacked = done[0]
    for part in done[1:]:
        stacked = stacked.unionByName(part)
    part = F.pmod(F.xxhash64("id", "table"), F.col("parts"))
    return stacked.select("table", "id", F.concat_ws("-", "table", "depth", "place", part).alias("unit"))


def hashed_knn(df: DataFrame, k: int, key: str = "row_id", features: str = "features", tables: int = TABLES,
               bucket: int = BUCKET, seed: int = 0) -> DataFrame:
    """(key, neighbour, rank, d2): the k nearest of the rows that share a bucket with a row in one of the tables.

    Distances are exact; a neighbour is missed if no table puts it into the row's bucket. Tables of at most ``bucket`` rows
    are compared whole. A row has fewer than k neighbours only if its buckets hold fewer rows.
    """
    coded = written(sign_codes(df, key, features, tables, seed), "coded")
    units = bucketed(coded, bucket)
    members = coded.select("table", "id", "x").join(units, ["table", "id"]).select("unit", "id", "x")

    def nearest(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), matrix_of(table["x"])
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        rows, cols, dist = [], [], []
        width = min(k + 1, len(ids))
        for at in range(0, len(ids), 256):
            part = x[at:at + 256]
            rough = fast_squared_distances(part, x)
            cut = np.partition(rough, width - 1, axis=1)[:, width - 1:width]
            i, j = np.nonzero(rough <= cut + 1e-9 * (np.square(part).sum(axis=1, keepdims=True) + np.square(x).sum(axis=1).max()))
            keep = i + at != j
            i, j = i[keep], j[keep]
            d2 = np.square(part[i] - x[j]).sum(axis=1)
            first = np.lexsort((j, d2, i))
            i, j, d2 = i[first], j[first], d2[first]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(ids[i[top] + at]), cols.append(ids[j[top]]), dist.append(d2[top])
        return pa.table({"id": np.concatenate(rows), "neighbour": np.concatenate(cols), "d2": np.concatenate(dist)})

    found = members.groupBy("unit").applyInArrow(nearest, "id long, neighbour long, d2 double")
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("d2", "neighbour"))), 1, k).alias("f"))
    out = written(best.select("id", F.posexplode("f").alias("rank", "e")).select(
        F.col("id").alias(key), F.col("e.neighbour").alias("neighbour"), "rank", F.col("e.d2").alias("d2")), "graph")
    drop_written(coded)
    return out
