"""Encoding of categoricals against the domain observed in a capture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.schema import ATTACK_CATEGORIES


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value) pairs of all columns in one pass; nulls are no value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.feature", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )


@dataclass
class FlowEncoderModel:
    """Encoded layout of a capture: numeric columns first, then one 0/1 column per known value."""

    numeric: list[str]
    domains: dict[str, list[str]]

    @property
    def feature_names(self) -> list[str]:
        return self.numeric + [f"{c}_{v}" for c, values in self.domains.items() for v in values]

    def indicator(self, column: str, value: str) -> Column:
        hit = F.coalesce(F.col(column).cast("string") == F.lit(value), F.lit(False))
        return hit.cast("int").alias(f"{column}_{value}")

    def transform_wide(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """One column per known value; unseen values and nulls give zeros, absent values give zero columns."""
        dummies = [self.indicator(c, v) for c, values in self.domains.items() for v in values]
        return df.select(*keep, *self.numeric, *dummies)

    def transform(self, df: DataFrame, output: str = "features", columns: list[str] | None = None) -> DataFrame:
        """The same layout as one array column; positions follow ``feature_names``."""
        parts = []
        if self.numeric:
            filled = [F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in self.numeric]
            parts.append(F.array(*filled))
        for column, values in self.domains.items():
            if columns is not None and column not in columns:
                continue
            if values:
                parts.append(_indicator_array(F.col(column).cast("string"), values))
        return df.withColumn(output, F.concat(*parts))


def _indicator_array(value: Column, values: list[str]) -> Column:
    known = F.array(*[F.lit(v) for v in values])
    return F.transform(known, lambda v: F.coalesce(v == value, F.lit(False)).cast("double"))


@dataclass
class FlowEncoder:
    """Learns the value domain of every categorical from a capture.

    The domain becomes the width of the feature vector, so its size is checked before it reaches the driver.
    """

    categorical: list[str]
    numeric: list[str]
    max_width: int = 10_000

    def fit(self, capture: DataFrame) -> FlowEncoderModel:
        rows = distinct_values(capture, self.categorical).limit(self.max_width + 1).collect()
        if len(rows) > self.max_width:
            raise ValueError(f"more than {self.max_width} distinct categorical values; not a categorical domain")
        domains = {c: sorted(r.value for r in rows if r.feature == c) for c in self.categorical}
        return FlowEncoderModel(list(self.numeric), domains)


def category_block(category="attack_cat", label="label") -> Column:
    """Ten 0/1 cells: nine attack names in code order, then ``label = 0``."""
    cells = [F.coalesce(F.col(category) == F.lit(c), F.lit(False)).cast("int") for c in ATTACK_CATEGORIES]
    normal = F.coalesce(F.col(label).cast("int") == 0, F.lit(False)).cast("int")
    return F.array(*cells, normal)


def split_feature_label(df: DataFrame, model: FlowEncoderModel, keep: list[str] = ()) -> DataFrame:
    """Features, the ten-wide category block and the binary label of an encoded row, cut by name."""
    columns = [c for c in model.domains if c not in ("attack_cat", "label")]
    encoded = model.transform(df, "features", columns)
    return encoded.select(
        *keep, "features", category_block().alias("category_block"), F.col("label").cast("int").alias("label")
    )
