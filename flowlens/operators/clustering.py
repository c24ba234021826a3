"""Clustering metrics: agreement with the labels from a contingency table, and shape in feature space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from flowlens.functions.vectors import list_column, matrix_of
from flowlens.operators import passes
from flowlens.operators.classification import pair_counts
from flowlens.session import drop_written, written

# keys that the pairs of marginals of a group are dealt over
_PARTS = 16
# rows whose distances to so many others are held at a time
_ROWS, _COLUMNS = 256, 4096


def contingency(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """(truth, cluster) counts with both marginals. Rows are class x cluster pairs, so the windows are small."""
    cells = pair_counts(df, truth, pred, by)
    return cells.select(
        *by, "t", "p", "n",
        F.sum("n").over(Window.partitionBy(*by, "t")).alias("a"),
        F.sum("n").over(Window.partitionBy(*by, "p")).alias("b"),
    )


def agreement_sums(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sums all agreement metrics share: pair counts and entropies (natural log)."""
    n, a, b = (F.col(c).cast("double") for c in ("n", "a", "b"))
    sums = cells.groupBy(*by).agg(
        F.sum(n).alias("total"),
        F.sum(n * (n - 1) / 2).alias("pairs"),
        F.sum(n * (a - 1) / 2).alias("pairs_t"),  # sum over classes of C(a, 2), spread over their cells
        F.sum(n * (b - 1) / 2).alias("pairs_p"),
        F.sum(n * F.ln(n)).alias("nlogn"), F.sum(n * F.ln(a)).alias("nloga"), F.sum(n * F.ln(b)).alias("nlogb"),
        F.count_distinct(F.struct("t")).alias("classes"), F.count_distinct(F.struct("p")).alias("clusters"),
    )
    total, log_total = F.col("total"), F.ln("total")
    h_t = F.when(F.col("classes") > 1, log_total - F.col("nloga") / total).otherwise(0.0)
    h_p = F.when(F.col("clusters") > 1, log_total - F.col("nlogb") / total).otherwise(0.0)
    mi = F.when((F.col("classes") > 1) & (F.col("clusters") > 1),
                (F.col("nlogn") - F.col("nloga") - F.col("nlogb")) / total + log_total).otherwise(0.0)
    return sums.withColumns({"h_truth": h_t, "h_pred": h_p, "mi": mi})


def adjusted_rand(sums: DataFrame) -> Column:
    s, a, b, n = (sums[c] for c in ("pairs", "pairs_t", "pairs_p", "total"))
    expected = F.try_divide(a * b, n * (n - 1) / 2)
    return F.coalesce(F.try_divide(s - expected, (a + b) / 2 - expected), F.lit(1.0))


def fowlkes_mallows(sums: DataFrame) -> Column:
    return F.coalesce(F.try_divide(sums["pairs"], F.sqrt(sums["pairs_t"]) * F.sqrt(sums["pairs_p"])), F.lit(0.0))


def homogeneity(sums: DataFrame) -> Column:
    return F.coalesce(F.try_divide(sums["mi"], sums["h_truth"]), F.lit(1.0))


def completeness(sums: DataFrame) -> Column:
    return F.coalesce(F.try_divide(sums["mi"], sums["h_pred"]), F.lit(1.0))


def v_measure(h: Column, c: Column) -> Column:
    return F.coalesce(F.try_divide(2 * h * c, h + c), F.lit(0.0))


def _log_factorial(v: np.ndarray) -> np.ndarray:
    """log v! of whole numbers: Stirling's series eight places further on, where four terms are exact to rounding."""
    x = v + 1.0
    y = x + 8.0
    steps = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    tail = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - steps



def expected_information(a: float, b: float, n: float) -> float:
    """Expected contribution of a cell with marginals a and b to the mutual information of n rows.

    The cell count is hypergeometric. All counts are summed while they are few; for wide distributions the
    sum runs over forty standard deviations either side in steps well below one, which is exact to rounding.
    """
    low, high = max(0.0, a + b - n), min(a, b)
    mean = a * b / n
    sd = math.sqrt(max(mean * (n - a) / n * (n - b) / max(n - 1, 1), 1e-12))
    low, high = max(low, math.floor(mean - 40 * sd - 50)), min(high, math.ceil(mean + 40 * sd + 50))
    step = max(1, int(sd // 16))
    k = np.arange(low, high + 1, step, dtype=np.float64)
    logs = -sum(_log_factorial(v) for v in (k, a - k, b - k, n - a - b + k))
    weight = np.exp(logs - logs.max())  # the terms free of k cancel when the weights are made to sum to one
    count = np.maximum(k, 1.0)
    return float((weight * k / n * (np.log(count) + math.log(n) - math.log(a) - math.log(b))).sum() / weight.sum())


@pandas_udf(DoubleType())
def _expected_information(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([expected_information(*cell) for cell in zip(a, b, n)], dtype="float64")


def expected_mutual_info(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, expected): E[MI] over all class x cluster pairs, empty cells included.

    A pair counts by its two marginals only, so equal marginals are one row with their number. Marginals of n rows have at most
    sqrt(2 n) values, so there are at most 2 n rows of pairs; they are dealt over ``_PARTS`` keys a group.
    """
    totals = cells.groupBy(*by).agg(F.sum("n").cast("double").alias("total"))

    def values(side: str, size: str) -> DataFrame:
        each = cells.groupBy(*by, side).agg(F.first(size).cast("double").alias(size))
        return each.groupBy(*by, size).agg(F.count("*").alias(f"{size} times"))

    left = values("t", "a").withColumn("part", F.pmod(F.xxhash64("a"), F.lit(_PARTS)).cast("int"))
    right = values("p", "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    pairs = _joined(_joined(left, right, by, "part"), totals, by)
    value = _expected_information("a", "b", "total") * F.col("a times") * F.col("b times")
    return pairs.repartition(*by, "a", "b").groupBy(*by).agg(F.sum(value).alias("expected"))


def _joined(left: DataFrame, right: DataFrame, by: list[str], *keys: str) -> DataFrame:
    """Join in which a null group is a group."""
    names = [*by, *keys]
    if not names:
        return left.join(F.broadcast(right))  # one row of totals
    other = right.withColumnsRenamed({k: f"{k} of other" for k in names})
    same = [F.col(k).eqNullSafe(F.col(f"{k} of other")) for k in names]
    return left.join(other, same).drop(*[f"{k} of other" for k in names])


def with_expected(sums: DataFrame, cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """``agreement_sums`` with the expected mutual information."""
    return _joined(sums, expected_mutual_info(cells, by), by)


def adjusted_mutual_info(sums: DataFrame, average: str = "arithmetic") -> Column:
    """From ``with_expected``."""
    ht, hp, mi, e = sums["h_truth"], sums["h_pred"], sums["mi"], sums["expected"]
    mean = {
        "arithmetic": (ht + hp) / 2, "max": F.greatest(ht, hp), "min": F.least(ht, hp), "geometric": F.sqrt(ht * hp)
    }[average]
    trivial = (sums["classes"] == sums["clusters"]) & (sums["classes"] == 1)
    return F.when(trivial, 1.0).otherwise(F.coalesce(F.try_divide(mi - e, mean - e), F.lit(0.0)))


def agreement_metrics(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """The six label-agreement metrics, one row per group."""
    cells = contingency(df, truth, pred, by)
    sums = with_expected(agreement_sums(cells, by), cells, by)
    h, c = homogeneity(sums), completeness(sums)
    return sums.select(
        *by, adjusted_rand(sums).alias("adj_rand_index"), adjusted_mutual_info(sums).alias("adj_mutual_info"),
        h.alias("homogeneity"), c.alias("completeness"), v_measure(h, c).alias("v-measure"),
        fowlkes_mallows(sums).alias("fowlkes-mallows"),
    )


def calinski_harabasz(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Between to within dispersion from per-cluster mean, variance and size (one aggregate)."""
    stats = (
        df.groupBy(cluster)
        .agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(features))).alias("s"))
        .select(F.col("s.count").cast("double").alias("n"), vector_to_array("s.mean").alias("mean"),
                vector_to_array("s.variance").alias("variance"))
    )
    dims = stats.select("n", F.posexplode(F.arrays_zip("mean", "variance")).alias("dim", "v")).select(
        "n", "dim", F.col("v.mean").alias("m"), F.col("v.variance").alias("var")
    )
    n, m = F.col("n"), F.col("m")
    per_dim = dims.groupBy("dim").agg(
        F.sum(n).alias("total"), F.count("*").alias("k"),
        (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)).alias("between"),
        F.sum((n - 1) * F.col("var")).alias("within"),
    )
    k, total = F.max("k"), F.max("total")
    value = F.try_divide(F.sum("between") * (total - k), F.sum("within") * (k - 1))
    return per_dim.agg(F.when(F.sum("within") == 0, 1.0).otherwise(value).alias("calinski_harabasz"))


def silhouette_rows(df: DataFrame, features: str, cluster: str, key: str) -> DataFrame:
    """(key, cluster, silhouette) of every row, from its distances to all others; rows without a cluster are one cluster.

    Rows meet each other in passes over slices of bounded size and keep the sum of their distances to each cluster.
    """
    spark = df.sparkSession
    named = written(df.select(F.col(key), F.col(features).cast("array<double>").alias("x"), F.col(cluster).alias("c")), "rows")
    sizes = named.groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()
    total = sum(r.n for r in sizes)
    width = named.agg(F.max(F.size("x"))).first()[0] or 0
    clusters = len(sizes)
    size = np.array([r.n for r in sizes], dtype=np.float64)
    codes = F.broadcast(spark.createDataFrame([(r.c, i) for i, r in enumerate(sizes)], named.select(F.col("c").alias("of"), F.lit(0).alias("code")).schema))
    rows = named.join(codes, F.col("c").eqNullSafe(F.col("of"))).drop("of").withColumns({
        "at": F.monotonically_increasing_id(), "sums": F.array_repeat(F.lit(0.0), clusters)})
    state = written(rows.repartition(passes.tasks_of(df, total, _ROWS)), "rows", compression="zstd")
    drop_written(named)
    # a table of its own, as the state is written anew in each pass
    base = written(state.select("at", "x", "code"), "base", compression="zstd")
    count = passes.slices_of(total, width)

    def meet(batches: Iterator[pa.RecordBatch], others: pa.Table) -> Iterator[pa.RecordBatch]:
        others = others.sort_by("at")
        at, code = others["at"].to_numpy(), others["code"].to_numpy()
        y = matrix_of(others["x"]) if len(at) else np.zeros((0, width))
        y = np.column_stack([-2 * y, np.ones(len(at)), (y * y).sum(axis=1)])
        member = np.eye(clusters)[code]
        for batch in batches:
            if not batch.num_rows:
                yield batch
                continue
            x, own = matrix_of(batch["x"]), batch["at"].to_numpy()
            x = np.column_stack([x, (x * x).sum(axis=1), np.ones(len(x))])
            same = np.searchsorted(at, own)
            here = np.nonzero(same < len(at))[0]
            here = here[at[same[here]] == own[here]]
            sums = matrix_of(batch["sums"]).copy()
            for low in range(0, len(x), _ROWS):
                part = x[low:low + _ROWS]
                for left in range(0, len(y), _COLUMNS):
                    square = part @ y[left:left + _COLUMNS].T
                    np.maximum(square, 0, out=square)
                    i = here[(here >= low) & (here < low + _ROWS) & (same[here] >= left) & (same[here] < left + _COLUMNS)]
                    square[i - low, same[i] - left] = 0.0  # rounding leaves a row some distance to itself
                    sums[low:low + _ROWS] += np.sqrt(square, out=square) @ member[left:left + _COLUMNS]
            yield batch.set_column(batch.schema.get_field_index("sums"), "sums", list_column(sums))

    state = passes.passed(state, base, [F.pmod(F.xxhash64("at"), F.lit(count)) == s for s in range(count if total else 0)], meet, "rows")
    drop_written(base)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, own = matrix_of(batch["sums"]) if batch.num_rows else np.zeros((0, clusters)), batch["code"].to_numpy()
            i = np.arange(len(own))
            inner = sums[i, own] / np.maximum(size[own] - 1, 1)
            means = sums / size
            means[i, own] = np.inf
            outer = means.min(axis=1, initial=np.inf)
            top = np.maximum(inner, outer)
            known = (size[own] > 1) & np.isfinite(outer) & (top > 0)
            value = np.zeros(len(own))
            value[known] = (outer[known] - inner[known]) / top[known]
            yield pa.RecordBatch.from_arrays([batch[key], batch["c"], pa.array(value)], [key, "cluster", "silhouette"])

    types = dict(df.dtypes)
    return state.select(key, "c", "code", "sums").mapInArrow(score, f"{key} {types[key]}, cluster {types[cluster]}, silhouette double")


def silhouette(df: DataFrame, features: str, cluster: str, key: str) -> DataFrame:
    return silhouette_rows(df, features, cluster, key).agg(F.avg("silhouette").alias("silhouette"))
