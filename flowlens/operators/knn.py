"""Exact k nearest neighbours of every row, and the affinity graph built on them.

Rows are grouped around pivots and lie in that order, in blocks of bounded size. They meet each other in passes over
broadcast slices of the table; a block is left out for a row if the triangle inequality leaves it no chance of holding one
of the row's k nearest. A row carries its k nearest so far. Copies of a vector are one vector with its k + 1 smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from flowlens.functions.vectors import list_column, matrix_of
from flowlens.operators import passes
from flowlens.operators.landmarks import affinities, choose_landmarks, fast_squared_distances, fetch
from flowlens.operators.landmarks import squared_distances
from flowlens.session import drop_written, written

_BLOCK = 2048
# rows that are compared with a block at a time
_ROWS = 512
_MAX_PIVOTS = 1024
_SLACK = 1e-6


def exact_knn(df: DataFrame, k: int, key: str = "row_id", features: str = "features", pivots: int | None = None,
              block: int = _BLOCK) -> DataFrame:
    """(key, neighbour, rank, d2): the k nearest other rows of every row, ties by smaller id.

    By default there is one pivot per block of rows, up to a bound.
    """
    pivots = pivots or int(min(_MAX_PIVOTS, max(1, df.count() // block)))
    rows = df.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("x"))
    # copies: a vector needs at most its k + 1 smallest ids to answer for all of them
    order = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    distinct = written(
        rows.withColumn("n", order).where(F.col("n") <= k + 1)
        .groupBy("x").agg(F.array_sort(F.collect_list(F.col("id").cast("long"))).alias("ids"))
        .withColumn("vec", F.get("ids", F.lit(0))), "vectors", compression="zstd"
    )
    _, centres = fetch(choose_landmarks(distinct, "vec", pivots), "vec", "x")
    if not len(centres):
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("neighbour"),
                           F.lit(0).alias("rank"), F.lit(0.0).alias("d2")).where(F.lit(False))

    @arrow_udf("int")
    def closest_centre(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], pa.int32())
        return pa.array(squared_distances(matrix_of(batch), centres).argmin(axis=1).astype(np.int32))

    placed = written(distinct.withColumn("home", closest_centre("x")), "placed", compression="zstd")
    drop_written(distinct)
    # rows of a group have places next to each other, one number per group reaches the driver
    sizes = {r.home: r.n for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}
    size = np.array([sizes.get(g, 0) for g in range(len(centres))])
    count = passes.slices_of(int(size.sum()), centres.shape[1])
    start = F.array(*[F.lit(int(v)) for v in np.cumsum(size) - size])
    among = F.array(*[F.lit(int(v)) for v in np.maximum(size, 1)])
    place = F.get(start, F.col("home")) + F.pmod(F.xxhash64("vec"), F.get(among, F.col("home")))
    share = max(1, -(-int(size.sum()) // count))
    width = k + 1
    ranged = placed.withColumn("place", place).repartitionByRange(passes.tasks_of(df, int(size.sum()), 2 * block), "place")
    base = written(ranged.sortWithinPartitions("place"), "base", compression="zstd")
    drop_written(placed)
    state = written(base.select(
        "vec", "x", "ids", F.lit(float("inf")).alias("bound"), F.array_repeat(F.lit(float("inf")), width).alias("d2"),
        F.array_repeat(F.lit(0).cast("long"), width).alias("near")), "nearest", compression="zstd")

    def meet(batches: Iterator[pa.RecordBatch], others: pa.Table) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(others, block)
        for batch in batches:
            if not batch.num_rows:
                yield batch
                continue
            x, bound = matrix_of(batch["x"]), batch["bound"].to_numpy().copy()
            d2, near = matrix_of(batch["d2"]).copy(), matrix_of(batch["near"]).copy()
            for at in range(0, len(x), block):
                part = slice(at, at + block)
                if np.isinf(bound[part]).any() and len(x[part]) > k:
                    bound[part] = np.minimum(bound[part], _kth(x[part], k))
                _nearer(x[part], bound[part], d2[part], near[part], blocks)
            for name, values in (("bound", pa.array(bound)), ("d2", list_column(d2)),
                                 ("near", pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, width, dtype=np.int32)), pa.array(near.ravel())))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, values)
            yield batch

    parts = [(F.col("place") >= at * share) & (F.col("place") < (at + 1) * share) for at in range(count)]
    state = passes.passed(state, base.select("x", "ids", "place"), parts, meet, "nearest")
    drop_written(base)
    # per vector: the k + 1 nearest ids, its own smallest id among them at distance 0
    found = F.filter(F.arrays_zip("d2", F.col("near").alias("neighbour")), lambda f: f["d2"] < float("inf"))
    answer = state.select("x", "ids", found.alias("found"))
    answered = answer.where(F.size("ids") <= k).select(F.explode("ids").alias("id"), "found")
    if state.where(F.size("ids") > k).limit(1).count():  # ids of further copies are in the table only
        copied = answer.where(F.size("ids") > k).select("x", "found")
        answered = answered.unionByName(rows.join(copied, "x").select(F.col("id").cast("long").alias("id"), "found"))
    others = F.slice(F.filter("found", lambda f: f["neighbour"] != F.col("id")), 1, k)
    return answered.select("id", F.posexplode(others).alias("rank", "f")).select(
        F.col("id").cast(dict(df.dtypes)[key]).alias(key), F.col("f.neighbour").alias("neighbour"), F.col("rank").alias("rank"),
        F.col("f.d2").alias("d2"),
    )


def _blocks(others: pa.Table, block: int) -> list[tuple]:
    """(vectors, ids, ids of each, centre, radius) of consecutive rows by place."""
    others = others.sort_by("place")
    out = []
    for at in range(0, len(others), block):
        part = others.slice(at, block).combine_chunks()
        y, ids = matrix_of(part["x"]), part["ids"].combine_chunks()
        centre = y.mean(axis=0)
        radius = np.sqrt(np.square(y - centre).sum(axis=1).max())
        out.append((y, ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False), centre, radius))
    return out


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """No less than the squared distance of each row to its k-th nearest other one."""
    square = fast_squared_distances(x, x)
    norm = np.square(x).sum(axis=1)
    return np.partition(square, k, axis=1)[:, k] + 1e-9 * (norm + norm.max())


def _nearer(x: np.ndarray, bound: np.ndarray, d2: np.ndarray, near: np.ndarray, blocks: list[tuple]) -> None:
    """Put the rows of the blocks that are among the nearest into ``d2`` and ``near``, which have them in order."""
    if not blocks:
        return
    centres, radii = np.stack([b[3] for b in blocks]), np.array([b[4] for b in blocks])
    gap = np.sqrt(fast_squared_distances(x, centres)) - radii
    slack = _SLACK * (1 + np.sqrt(np.square(x).sum(axis=1)) + np.sqrt(np.square(centres).sum(axis=1).max()))
    for number in np.argsort(gap.min(axis=0), kind="stable"):
        cut = np.minimum(bound, d2[:, -1])
        open_to = np.nonzero(gap[:, number] <= np.sqrt(cut) * (1 + _SLACK) + slack)[0]  # by the triangle inequality
        y, ids, copies = blocks[number][:3]
        for at in range(0, len(open_to), _ROWS):
            rows = open_to[at:at + _ROWS]
            i, j, square = _within(x[rows], y, cut[rows], d2.shape[1])
            if len(i):
                times = copies[j]
                first = np.repeat(np.cumsum(copies)[j] - times, times)
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                _merge(d2, near, np.repeat(rows[i], times), np.repeat(square, times), ids[first + within])


def _within(x: np.ndarray, y: np.ndarray, cut: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2) of the pairs no further apart than ``cut``, but for pairs behind ``wanted`` nearer ones of the same row.

    One product in single precision proposes pairs, with a margin for its rounding; they are measured exactly.
    """
    middle = x.mean(axis=0)
    p, q = x - middle, y - middle
    norm, other = np.square(p).sum(axis=1), np.square(q).sum(axis=1)
    kind = np.float32 if 1e-25 < norm.max() + other.max() < 1e30 else np.float64
    margin = 4 * (x.shape[1] + 4) * np.finfo(kind).eps * (norm + other.max()) + 1e-14 * (np.square(x).sum(axis=1) + np.square(y).sum(axis=1).max())
    likeness = p.astype(kind) @ q.astype(kind).T
    likeness -= (other / 2).astype(kind)
    hit = likeness >= ((norm - cut - margin) / 2).astype(kind)[:, None]
    if len(y) > wanted and np.count_nonzero(hit) > 4 * wanted * len(x):
        last = np.partition(likeness, len(y) - wanted, axis=1)[:, len(y) - wanted]
        hit &= likeness >= (last - margin).astype(kind)[:, None]
    i, j = np.nonzero(hit)
    square = np.empty(len(i))
    step = max(1, 4_000_000 // x.shape[1])
    for at in range(0, len(i), step):
        square[at:at + step] = np.square(x[i[at:at + step]] - y[j[at:at + step]]).sum(axis=1)
    keep = square <= cut[i]
    return i[keep], j[keep], square[keep]


def _merge(d2: np.ndarray, near: np.ndarray, i: np.ndarray, square: np.ndarray, ids: np.ndarray) -> None:
    """The first ones by distance and id, of what rows have and of the new pairs; rows without new ones stay."""
    rows, of = np.unique(i, return_inverse=True)
    wanted = d2.shape[1]
    r = np.concatenate([np.repeat(np.arange(len(rows)), wanted), of])
    every, names = np.concatenate([d2[rows].ravel(), square]), np.concatenate([near[rows].ravel(), ids])
    order = np.lexsort((names, every, r))
    r = r[order]
    kept = order[np.arange(len(r)) - np.searchsorted(r, r) < wanted]
    d2[rows], near[rows] = every[kept].reshape(-1, wanted), names[kept].reshape(-1, wanted)


def knn_affinity(df: DataFrame, perplexity: float = 30.0, key: str = "row_id", features: str = "features",
                 neighbours: DataFrame | None = None) -> DataFrame:
    """(a, b, p): symmetric affinities over the k = 3 x perplexity nearest neighbours; they sum to one.

    p(b|a) is Gaussian with the row's own bandwidth, set so that its entropy is log(perplexity);
    p = (p(b|a) + p(a|b)) / 2n.
    """
    k = max(1, int(3 * perplexity))
    if neighbours is None:
        neighbours = exact_knn(df, k, key, features)

    @arrow_udf("array<double>")
    def shares(batch: pa.Array) -> pa.Array:
        lengths = batch.value_lengths().to_numpy(zero_copy_only=False)
        out = np.empty(lengths.sum())
        starts = np.concatenate([[0], np.cumsum(lengths)])
        values = batch.flatten().to_numpy()
        for width in np.unique(lengths):  # all rows have k neighbours, unless the table is smaller
            cells = starts[:-1][lengths == width][:, None] + np.arange(width)
            out[cells] = affinities(values[cells], perplexity)[0]
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out))

    lists = neighbours.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "d2"))).alias("f"))
    one_way = written(lists.select(
        F.col(key).alias("a"), F.explode(F.arrays_zip(F.col("f.neighbour").alias("b"),
                                                     shares(F.col("f.d2")).alias("p"))).alias("e")
    ).select("a", F.col("e.b").alias("b"), F.col("e.p").alias("p")), "shares", compression="zstd")  # read twice
    n = df.count()
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "p"))
    return both.groupBy("a", "b").agg((F.sum("p") / F.lit(2.0 * max(n, 1))).alias("p"))
