"""Cleaning, encoding and scaling on literal rows."""

import math

import pytest
from pyspark.sql import Row, functions as F

from flowlens.functions import cleaning, codes, vectors
from flowlens.operators import encode, scale, split
from flowlens.schema import CATEGORY_FIXES


def values(df, column):
    return [r[column] for r in df.collect()]


def test_five_spellings_are_fixed_and_nothing_else(spark):
    names = [*CATEGORY_FIXES, " Worms ", "Fuzzers", None]
    df = spark.createDataFrame([(n,) for n in names], "attack_cat string").coalesce(1)
    assert values(cleaning.clean_category(df), "attack_cat") == [*CATEGORY_FIXES.values(), " Worms ", "Fuzzers", None]
    assert values(cleaning.clean_category(df, trim=True), "attack_cat")[5] == "Worms"


def test_rate_edges(spark):
    rows = [(3, 2, 2.0), (3, 2, 0.0), (1, 0, 0.0), (0, 0, 0.0)]
    df = spark.createDataFrame(rows, "spkts long, dpkts long, dur double").coalesce(1)
    assert values(df.select(cleaning.rate().alias("r")), "r") == [2.0, 0.0, 0.0, -math.inf]
    assert values(df.select(cleaning.rate(strict_finite=True).alias("r")), "r")[-1] == 0.0


def test_blank_count_is_null_and_bad_text_raises(spark):
    df = spark.createDataFrame([(" ",), ("3",), ("4 5",), (None,)], "ct_ftp_cmd string").coalesce(1)
    assert values(df.select(cleaning.blank_to_null().alias("v")), "v") == [None, 3.0, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("abc",)], "ct_ftp_cmd string").select(cleaning.blank_to_null().alias("v")).collect()


def test_fill_nulls_covers_nan_null_and_text(spark):
    df = spark.createDataFrame([(None, None, None), (float("nan"), 3, "a")], "d double, i int, s string").coalesce(1)
    assert [tuple(r) for r in cleaning.fill_nulls(df).collect()] == [(0.0, 0, "0"), (0.0, 3, "a")]


def test_families(spark):
    df = spark.createDataFrame([("tcp", 1.0, "1")], "proto string, dur double, label string")
    assert cleaning.select_family(df, "categorical").columns == ["proto", "label"]
    assert cleaning.select_family(df, "numeric").columns == ["dur", "label"]
    with pytest.raises(ValueError):
        cleaning.select_family(df, "other")


def test_unseen_and_missing_categories(spark):
    capture = spark.createDataFrame([("tcp",), ("udp",), (None,)], "proto string")
    model = encode.FlowEncoder(["proto"], []).fit(capture)
    other = spark.createDataFrame([("tcp",), ("arp",), (None,)], "proto string").coalesce(1)
    assert [tuple(r) for r in model.transform_wide(other).collect()] == [(1, 0), (0, 0), (0, 0)]
    assert values(model.transform(other), "features") == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_domain_size_is_checked(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        encode.FlowEncoder(["c"], [], max_width=10).fit(df)


def test_category_numbers_agree(spark):
    rows = [("Worms", "1"), (None, "0"), (None, "1"), ("DoS", "0"), ("Other", "0")]
    df = spark.createDataFrame(rows, "attack_cat string, label string").coalesce(1)
    by_block = values(df.select(vectors.argmax(encode.category_block()).alias("c")), "c")
    assert by_block == values(df.select(codes.category_number().alias("c")), "c") == [8, 9, 0, 2, 9]


def test_constant_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double").coalesce(1)
    out = scale.ColumnScaler.fit(df, ["a", "b"]).transform(df).collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0), (0.0, 1.0)]
    assert math.isnan(scale.ColumnScaler.fit(df, ["a"], constant="nan").transform(df).first().a)
    arrays = df.select(F.array("a", "b").alias("features"))
    assert values(scale.VectorScaler.fit(arrays).transform(arrays), "features") == [[0.0, 0.0], [0.0, 1.0]]
    assert math.isnan(scale.VectorScaler.fit(arrays, constant="nan").transform(arrays).first().features[0])


def test_scaling_is_not_clipped(spark):
    capture = spark.createDataFrame([(0.0,), (10.0,)], "a double")
    other = spark.createDataFrame([(-5.0,), (20.0,)], "a double").coalesce(1)
    assert values(scale.ColumnScaler.fit(capture, ["a"]).transform(other), "a") == [-0.5, 2.0]


def test_threshold_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (1.5,)], "s double").coalesce(1)
    assert values(df.select(vectors.threshold("s").alias("t")), "t") == [0, 1, 2]


def test_argmax_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 2.0, 2.0],)], "a array<double>").coalesce(1)
    assert values(df.select(vectors.argmax("a").alias("i")), "i") == [0, 1]
    assert values(df.select(vectors.one_hot_of(vectors.argmax("a"), 3).alias("h")), "h") == [[1, 0, 0], [0, 1, 0]]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_index_is_contiguous_for_any_partitioning(spark, partitions):
    df = spark.range(1000).select(F.pmod(F.col("id"), F.lit(3)).alias("k"), (F.lit(5000) - F.col("id")).alias("v"))
    out = split.assign_index(df.repartition(partitions), ["k", "v"], partitions=partitions).orderBy("k", "v").collect()
    assert [r["index"] for r in out] == list(range(1000))


def test_hash_split_is_stable_and_about_a_fifth(spark):
    df = spark.range(10_000)
    def picked(d):
        return {r.id for r in split.random_split(d, split.hash_bucket("id")).where("split = 'val'").collect()}
    first = picked(df)
    assert first == picked(df.repartition(5)) and 1800 < len(first) < 2200


def test_decoding_unknown(spark):
    df = spark.createDataFrame([Row(c=-1), Row(c=9), Row(c=0)]).coalesce(1)
    assert values(df.select(codes.category_name("c").alias("n")), "n") == ["Unknown", "label_0", "Analysis"]
