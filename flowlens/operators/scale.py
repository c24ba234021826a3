"""Min-max scaling with statistics taken from a reference table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def minmax_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its minimum and maximum, from a single aggregate over the table."""
    stats = df.agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"min_{c}").alias("lo"), F.col(f"max_{c}").alias("hi"))
        for c in columns
    ]
    return stats.select(F.inline(F.array(*rows)))


def _unit(value: Column, lo: float, hi: float, constant: str) -> Column:
    if lo is None or hi == lo:
        return F.lit(float("nan")) if constant == "nan" else F.lit(0.0)
    return (value - F.lit(lo)) / F.lit(hi - lo)


@dataclass
class ColumnScaler:
    """(x - min) / (max - min) per column, never clipped; ``constant`` columns give 0 or NaN."""

    bounds: dict[str, tuple[float, float]]
    constant: str = "zero"

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], constant: str = "zero") -> ColumnScaler:
        return cls({r.feature: (r.lo, r.hi) for r in minmax_stats(df, columns).collect()}, constant)

    @classmethod
    def fit_joint(cls, frames: list[DataFrame], columns: list[str], constant: str = "zero") -> ColumnScaler:
        """Statistics over several tables together."""
        return cls.fit(reduce(DataFrame.unionByName, [f.select(*columns) for f in frames]), columns, constant)

    def column(self, name: str) -> Column:
        lo, hi = self.bounds[name]
        return _unit(F.col(name).cast("double"), lo, hi, self.constant)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.bounds})


@dataclass
class VectorScaler:
    """The same for an array column."""

    lo: list[float]
    hi: list[float]
    constant: str = "zero"

    @classmethod
    def fit(cls, df: DataFrame, features: str = "features", constant: str = "zero") -> VectorScaler:
        vector = array_to_vector(F.col(features))
        stats = df.select(Summarizer.metrics("min", "max").summary(vector).alias("s"))
        row = stats.select(vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi")).first()
        return cls(list(row.lo), list(row.hi), constant)

    def transform(self, df: DataFrame, features: str = "features", output: str | None = None) -> DataFrame:
        width = [h - l for l, h in zip(self.lo, self.hi)]
        lo = F.array(*[F.lit(v) for v in self.lo])
        span = F.array(*[F.lit(w if w else None).cast("double") for w in width])
        flat = float("nan") if self.constant == "nan" else 0.0

        def unit(value, i):
            return F.coalesce((value - F.get(lo, i)) / F.get(span, i), F.lit(flat))

        return df.withColumn(output or features, F.transform(features, unit))
