"""Codes, display names, verdicts and fixed-decimal text for scored flows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens.schema import ATTACK_CATEGORIES, CATEGORY_LABELS, NORMAL, VERDICTS


def category_number(category="attack_cat", label="label") -> Column:
    """Category code of a flow.

    Mirrors the first maximum over the indicator block (nine attack names, then normal): a known
    attack name wins, then ``label = 0``, and a flow with neither falls to code 0.
    """
    known = F.array(*[F.lit(c) for c in ATTACK_CATEGORIES])
    position = F.coalesce(F.array_position(known, F.col(category)), F.lit(0))
    return (
        F.when(position > 0, position - 1)
        .when(F.col(label).cast("int") == 0, F.lit(NORMAL))
        .otherwise(F.lit(0))
        .cast("int")
    )


def _name(code, names: list[str]) -> Column:
    table = F.array(*[F.lit(n) for n in names])
    return F.coalesce(F.get(table, F.col(code).cast("int")), F.lit("Unknown"))


def category_name(code) -> Column:
    return _name(code, CATEGORY_LABELS)


def category_column_name(code) -> Column:
    """Name of the encoded column that holds the category."""
    return _name(code, [f"attack_cat_{c}" for c in ATTACK_CATEGORIES] + ["label_0"])


def verdict_name(code) -> Column:
    return _name(code, VERDICTS)


def binary_agrees(prediction, category="category") -> Column:
    """Does a Normal/Attack prediction agree with the true category?"""
    return F.col(prediction) == (F.col(category) != NORMAL).cast("int")


def marked(agrees: Column, text: Column) -> Column:
    """Text with a tick or a cross in front."""
    return F.concat(F.when(agrees, F.lit("✅ ")).otherwise(F.lit("❌ ")), text)


def fixed_decimals(value, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", value)


def code_columns(predictions: list[str]) -> dict[str, Column]:
    """Integer and text forms of every prediction column."""
    out: dict[str, Column] = {}
    for name in predictions:
        out[name] = F.col(name).cast("int")
        out[f"{name}_str"] = F.col(name).cast("int").cast("string")
    return out
