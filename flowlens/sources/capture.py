"""Readers for headerless capture parts and labelled tables with a header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowlens.schema import (
    BLANKABLE_COLUMN, CAPTURE_COLUMNS, CAPTURE_SCHEMA, CATEGORICAL_COLUMNS, MODEL_COLUMNS, TIME_COLUMNS,
)


def scan_capture(spark: SparkSession, parts: list[str], header: bool = False) -> DataFrame:
    """Headerless parts as one table under the fixed schema; a multi-path scan, so nothing is concatenated."""
    return spark.read.schema(CAPTURE_SCHEMA).option("header", header).csv(list(parts))


def prune_columns(df: DataFrame) -> DataFrame:
    """The 43 columns models read."""
    return df.select(*MODEL_COLUMNS)


def scan_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A labelled CSV by header name: blanks around names are ignored, order and extra columns are free.

    Categoricals and the blank-able count stay text, the rest are doubles.
    """
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip(): c for c in raw.columns}
    missing = [c for c in MODEL_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    text = {*CATEGORICAL_COLUMNS, BLANKABLE_COLUMN}
    return raw.select(*[
        F.col(f"`{names[c]}`").alias(c) if c in text else F.col(f"`{names[c]}`").cast("double").alias(c)
        for c in MODEL_COLUMNS
    ])


def assign_roles(frames: dict[str, DataFrame]) -> DataFrame:
    """(file, rows, role): the larger labelled table is the training table, whatever its name says."""
    tagged = [df.select(F.lit(name).alias("file")) for name, df in frames.items()]
    counts = reduce(DataFrame.unionByName, tagged).groupBy("file").agg(F.count("*").alias("rows"))
    largest = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rows"), "file"))  # one row per file
    return counts.select("file", "rows", F.when(largest == 1, "train").otherwise("test").alias("role"))


def write_capture(df: DataFrame, path: str) -> None:
    """Headerless CSV in capture column order; blanks inside values are kept."""
    (df.select(*CAPTURE_COLUMNS).write.mode("overwrite")
     .options(header=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))


def write_labelled(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite")
     .options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
