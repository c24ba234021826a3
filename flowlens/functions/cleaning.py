"""Column expressions that clean and derive flow fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from flowlens.schema import BLANKABLE_COLUMN, CATEGORY_FIXES


def clean_category(df: DataFrame, column: str = "attack_cat", trim: bool = False) -> DataFrame:
    """Correct the known misspellings; ``trim`` also strips blanks from any other value."""
    if trim:
        df = df.withColumn(column, F.trim(column))
    return df.replace(CATEGORY_FIXES, subset=[column])


def rate(spkts="spkts", dpkts="dpkts", dur="dur", strict_finite: bool = False) -> Column:
    """(spkts + dpkts - 1) / dur, with 0 where the quotient is +inf or undefined.

    A negative numerator over a zero duration stays -inf unless ``strict_finite``.
    """
    packets = (F.col(spkts) + F.col(dpkts) - 1).cast("double")
    below = F.lit(0.0) if strict_finite else F.lit(float("-inf"))
    at_zero = F.when(packets < 0, below).otherwise(F.lit(0.0))
    return F.when(F.col(dur) == 0, at_zero).otherwise(packets / F.col(dur))


def blank_to_null(column=BLANKABLE_COLUMN) -> Column:
    """Any cell containing white space becomes null; the rest must be a number (bad text raises)."""
    return F.when(~F.col(column).rlike(r"\s"), F.col(column)).cast("double")


def fill_nulls(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every null or NaN becomes 0 (``'0'`` in text columns)."""
    out = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if field.name in keep:
            out.append(col)
        elif isinstance(field.dataType, StringType):
            out.append(F.coalesce(col, F.lit("0")).alias(field.name))
        elif field.dataType.typeName() in ("double", "float"):
            out.append(F.nanvl(F.coalesce(col, F.lit(0.0)), F.lit(0.0)).cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, NumericType):
            out.append(F.coalesce(col, F.lit(0)).cast(field.dataType).alias(field.name))
        else:
            out.append(col)
    return df.select(*out)


def clean_flows(df: DataFrame, strict_finite: bool = False, trim: bool = False) -> DataFrame:
    """All cleaning steps on a table holding the model columns."""
    df = clean_category(df, trim=trim)
    return df.withColumns({"rate": rate(strict_finite=strict_finite), BLANKABLE_COLUMN: blank_to_null()})


def select_family(df: DataFrame, family: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``categorical``: the non-numeric columns; ``numeric``: the numeric ones plus the label; ``all``."""
    if family == "all":
        return df
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    if family == "categorical":
        names = [c for c in df.columns if c in keep or c not in numeric]
    elif family == "numeric":
        names = [c for c in df.columns if c in keep or (c in numeric and c != "label")] + ["label"]
    else:
        raise ValueError(f"unknown column family {family!r}")
    return df.select(*names)

