"""Metrics against hand-made tables and plain Python formulas."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from flowlens.operators import classification as cls, clustering as clu, rolling, scores


@pandas_udf(DoubleType())
def spread(v: pd.Series) -> float:
    return float(v.max() - v.min())


SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
labels = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=2, max_size=60)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "t int, p int")


def test_binary_counts_and_far(spark):
    rows = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 3
    m = cls.binary_metrics(pairs(spark, rows), "t", "p").first()
    assert (m.accuracy, m.precision, m.recall) == pytest.approx((9 / 12, 3 / 5, 3 / 4))
    assert m.far == pytest.approx((2 / 8 + 1 / 4) / 2)


def test_absent_class(spark):
    m = cls.binary_metrics(pairs(spark, [(0, 0), (0, 0)]), "t", "p").first()
    assert (m.accuracy, m.precision, m.recall, m.f1, m.far) == (1.0, 0.0, 0.0, 0.0, None)


def test_labels_seen_on_one_side_only(spark):
    out = cls.per_class_metrics(pairs(spark, [(2, 5), (2, 2), (7, 2)]), "t", "p").orderBy("class").collect()
    assert [(r["class"], r.dense_position, r.tp, r.support, r.predicted) for r in out] == [
        (2, 0, 1, 2, 2), (5, 1, 0, 0, 1), (7, 2, 0, 1, 0)]
    assert [r.f1 for r in out] == [0.5, 0.0, 0.0]


def test_confusion_is_zero_filled(spark):
    out = cls.category_confusion(pairs(spark, [(9, 0), (9, 0), (3, 1)]), "t", "p").collect()
    assert len(out) == 10 and sum(r.normal + r.attack for r in out) == 3


@SLOW
@given(rows=labels)
def test_micro_f1_is_accuracy(spark, rows):
    m = cls.averaged_metrics(pairs(spark, rows), "t", "p").first()
    share = sum(t == p for t, p in rows) / len(rows)
    assert m.f1_micro == pytest.approx(share) and m.accuracy == pytest.approx(share)
    assert all(0 <= v <= 1 for v in m)


def test_indicator_rows(spark):
    rows = [([1, 0, 0], [1, 0, 0]), ([0, 1, 0], [1, 0, 0]), ([0, 0, 1], [0, 0, 0])]
    m = cls.indicator_metrics(spark.createDataFrame(rows, "t array<int>, p array<int>"), "t", "p", 3).first()
    assert m.accuracy == pytest.approx(1 / 3)
    assert (m.precision_micro, m.recall_micro) == pytest.approx((1 / 2, 1 / 3))
    assert m.f1_macro == pytest.approx((2 / 3) / 3)


def reference_agreement(rows):
    """Plain formulas over dictionaries."""
    n, cells = len(rows), Counter(rows)
    a, b = Counter(t for t, _ in rows), Counter(p for _, p in rows)
    c2 = lambda x: x * (x - 1) / 2
    s, pa, pb = (sum(map(c2, c.values())) for c in (cells, a, b))
    e = pa * pb / c2(n)
    ari = 1.0 if (pa + pb) / 2 == e else (s - e) / ((pa + pb) / 2 - e)
    fmi = s / math.sqrt(pa * pb) if pa and pb else 0.0
    entropy = lambda c: -sum(v / n * math.log(v / n) for v in c.values())
    mi = sum(v / n * math.log(n * v / (a[t] * b[p])) for (t, p), v in cells.items())
    h = mi / entropy(a) if len(a) > 1 else 1.0
    c = mi / entropy(b) if len(b) > 1 else 1.0
    emi = 0.0
    for x in a.values():
        for y in b.values():
            for k in range(max(1, x + y - n), min(x, y) + 1):
                chance = math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y)
                emi += k / n * math.log(n * k / (x * y)) * chance
    top, bottom = mi - emi, (entropy(a) + entropy(b)) / 2 - emi
    ami = 1.0 if len(a) == len(b) == 1 else (top / bottom if abs(bottom) > 1e-12 else None)
    return ari, fmi, h, c, ami


@SLOW
@given(rows=labels)
def test_agreement_metrics(spark, rows):
    m = clu.agreement_metrics(pairs(spark, rows), "t", "p").first()
    ari, fmi, h, c, ami = reference_agreement(rows)
    assert m["adj_rand_index"] == pytest.approx(ari, abs=1e-9)
    assert m["fowlkes-mallows"] == pytest.approx(fmi, abs=1e-9)
    assert (m["homogeneity"], m["completeness"]) == pytest.approx((h, c), abs=1e-9)
    if ami is not None:
        assert m["adj_mutual_info"] == pytest.approx(ami, abs=1e-7)
    renamed = clu.agreement_metrics(pairs(spark, [(3 - t, (p + 1) % 4) for t, p in rows]), "t", "p").first()
    assert renamed["adj_rand_index"] == pytest.approx(m["adj_rand_index"], abs=1e-9)


def test_equal_labelings_score_one(spark):
    m = clu.agreement_metrics(pairs(spark, [(i % 3, 7 - i % 3) for i in range(30)]), "t", "p").first()
    assert [m[c] for c in m.asDict()] == pytest.approx([1.0] * 6)


def test_expected_information_for_wide_distributions():
    """Steps between the summed counts change nothing visible."""
    n, a, b = 4_000_000.0, 1_500_000.0, 2_200_000.0
    k = np.arange(a * b / n - 20_000, a * b / n + 20_000)
    sd2 = a * b / n * (n - a) / n * (n - b) / (n - 1)
    assert math.sqrt(sd2) > 64  # several counts per step
    weight = np.exp(-0.5 * (k - a * b / n) ** 2 / sd2)
    normal = (weight * k / n * np.log(n * k / (a * b))).sum() / weight.sum()
    assert clu.expected_information(a, b, n) == pytest.approx(normal, abs=2e-9)


def test_silhouette_and_dispersion(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 1, (20, 3)) for c in (0, 4)] + [np.array([[9.0, 9, 9]])])
    y = [0] * 20 + [1] * 20 + [2]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, y))],
                               "row_id long, features array<double>, c int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y = np.array(y)
    want = []
    for i in range(len(x)):
        same = y == y[i]
        if same.sum() == 1:
            want.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, y == c].mean() for c in set(y) - {y[i]})
        want.append((b - a) / max(a, b))
    assert clu.silhouette(df, "features", "c", "row_id").first()[0] == pytest.approx(np.mean(want))
    within = sum(((x[y == c] - x[y == c].mean(0)) ** 2).sum() for c in set(y))
    between = sum((y == c).sum() * ((x[y == c].mean(0) - x.mean(0)) ** 2).sum() for c in set(y))
    value = clu.calinski_harabasz(df, "features", "c").first()[0]
    assert value == pytest.approx((between / 2) / (within / (len(x) - 3)))


def test_silhouette_of_every_row(spark, monkeypatch):
    """More rows than the bound of the former sample, met in several slices."""
    monkeypatch.setattr(clu.passes, "SLICE_BYTES", 100_000)
    n = 20_500
    x = (np.arange(n) % 7 + np.arange(n) / n) * 1.5
    y = np.arange(n) * 3 // n
    df = spark.range(n).select("id", F.expr(f"array((id % 7 + id / {n}) * 1.5, 1.0D)").alias("features"), F.expr(f"cast(id * 3 div {n} as int)").alias("c"))
    want = np.zeros(n)
    for at in range(0, n, 1000):
        d = np.abs(x[at:at + 1000, None] - x[None])
        own = y[at:at + 1000]
        means = np.stack([d[:, y == c].mean(axis=1) for c in range(3)], axis=1)
        i = np.arange(len(own))
        size = np.bincount(y)[own]
        a = means[i, own] * size / (size - 1)
        means[i, own] = np.inf
        want[at:at + 1000] = (means.min(axis=1) - a) / np.maximum(a, means.min(axis=1))
    found = {r.id: r.silhouette for r in clu.silhouette_rows(df, "features", "c", "id").collect()}
    assert len(found) == n
    assert [found[i] for i in range(n)] == pytest.approx(want.tolist(), abs=1e-6)


def test_silhouette_of_few_and_of_no_rows(spark):
    rows = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [3.0, 4.0], None), (2, [3.0, 4.0], None)]
    df = spark.createDataFrame(rows, "k long, v array<double>, c int")
    assert [(r.k, r.cluster, r.silhouette) for r in clu.silhouette_rows(df, "v", "c", "k").orderBy("k").collect()] == [
        (0, 1, 1.0), (1, 1, 1.0), (2, None, 1.0), (2, None, 1.0)]
    assert [r.silhouette for r in clu.silhouette_rows(df.where("c = 1"), "v", "c", "k").collect()] == [0.0, 0.0]
    assert clu.silhouette(df.limit(0), "v", "c", "k").first()[0] is None


@pytest.mark.parametrize("n,block", [(1, 7), (5, 5), (7, 50), (20, 33)])
def test_last_n_equals_plain_windows(spark, n, block):
    df = spark.range(150).select(F.col("id").alias("i"), F.pmod(F.col("id") * 7, F.lit(10)).cast("int").alias("c"),
                                 F.pmod(F.col("id") * 5, F.lit(2)).cast("int").alias("p")).repartition(5)
    top = rolling.last_n(df, "i", n, {"m": F.max("c"), "k": F.count(F.lit(1))}, block=block).orderBy("i").collect()
    sums = rolling.last_n_sums(df, "i", n, {"s": F.col("c")}, block=block).orderBy("i").collect()
    value = [7 * i % 10 for i in range(150)]
    held = [value[max(0, i - n + 1): i + 1] for i in range(150)]
    assert [(r.m, r.k) for r in top] == [(max(v), len(v)) for v in held]
    assert [r.s for r in sums] == [sum(v) for v in held]
    matrix = rolling.rolling_category_confusion(df, "i", "c", "p", n, block).orderBy("i").collect()
    assert all(sum(r[1:]) == len(v) for r, v in zip(matrix, held))


@pytest.mark.parametrize("index", ["id * 5", "id * id - 300", "-3 * id", "id div 2"])
def test_last_n_over_an_index_with_gaps(spark, index):
    df = spark.range(400).selectExpr(f"{index} AS i", "id").repartition(5)
    top = rolling.last_n(df, "i", 20, {"k": F.count(F.lit(1)), "low": F.min("i")}, block=32).orderBy("i", "k").collect()
    sums = rolling.last_n_sums(df, "i", 20, {"s": F.col("i")}, block=32).orderBy("i").collect()
    keys = sorted(r.i for r in df.collect())
    assert [(r.i, r.k) for r in top] == [(x, min(at + 1, 20)) for at, x in enumerate(keys)]
    assert [r.low for r in top] == [keys[max(0, at - 19)] for at in range(400)]
    assert sorted(r.s for r in sums) == sorted(sum(keys[max(0, at - 19) : at + 1]) for at in range(400))


def test_block_must_hold_the_window(spark):
    with pytest.raises(ValueError):
        rolling.last_n(spark.range(5), "id", 10, {}, block=5)


def test_one_run_has_no_deviation_and_any_reducer_folds(spark):
    row = (0, "tree", "binary", "original", "test", "f1", 0.25)
    df = spark.createDataFrame([row], "run int, classifier string, task string, space string, split string, "
                                      "metric string, value double")
    out = scores.run_mean_std(df).first()
    assert (out["mean"], out["std"]) == (0.25, 0.0)
    more = df.union(spark.createDataFrame([(1, *row[1:-1], 0.75)], df.schema))

    assert scores.run_aggregate(more, lambda c: F.max(c) - F.min(c)).first()["value"] == 0.5
    assert scores.run_aggregate(more, spread).first()["value"] == 0.5
    wide = scores.score_table_wide(scores.run_aggregate(more, F.avg)).first()
    assert wide["original"] == 0.5 and wide["reduced_val"] is None


def test_expected_information_of_thousands_of_classes_and_clusters(spark):
    """Uneven marginals: equal ones are one row, and no row holds a list of them."""
    k = 2000
    i = F.col("id")
    rows = spark.range(60_000).select(
        F.when(i < k, i).otherwise(F.pmod(F.xxhash64(i), F.lit(k)) * F.pmod(i, F.lit(3))).cast("int").alias("t"),
        F.when(i < k, i).otherwise(F.pmod(F.xxhash64(i, F.lit(1)), F.lit(k))).cast("int").alias("p"))
    cells = clu.contingency(rows, "t", "p")
    got = clu.expected_mutual_info(cells)
    assert "collect" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    counts = rows.toPandas()
    a, b = (counts[c].value_counts().value_counts() for c in ("t", "p"))
    assert a.sum() == 3000 and b.sum() == k
    want = sum(x_times * y_times * clu.expected_information(float(x), float(y), 60_000.0)
               for x, x_times in a.items() for y, y_times in b.items())
    assert got.first().expected == pytest.approx(want, rel=1e-12)


def test_adjusted_information_keeps_a_null_group(spark):
    rows = spark.createDataFrame([(g, i % 3, (i * 7 % 5) // 2) for g in ("x", None) for i in range(40)], "g string, t int, p int")
    found = {r.g: r.adj_mutual_info for r in clu.agreement_metrics(rows, "t", "p", ["g"]).collect()}
    whole = clu.agreement_metrics(rows.where("g = 'x'"), "t", "p").first().adj_mutual_info
    assert set(found) == {"x", None} and all(v == pytest.approx(whole, abs=1e-12) for v in found.values())
