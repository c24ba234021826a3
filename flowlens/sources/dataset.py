"""From capture and labelled tables to one model-ready table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.cleaning import clean_flows, fill_nulls
from flowlens.functions.codes import category_number
from flowlens.operators.encode import FlowEncoder, FlowEncoderModel
from flowlens.operators.scale import VectorScaler
from flowlens.operators.split import random_split
from flowlens.schema import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS
from flowlens.session import work_path, written
from flowlens.sources.capture import scan_labelled

FEATURE_CATEGORICALS = [c for c in CATEGORICAL_COLUMNS if c not in ("attack_cat", "label")]


@dataclass
class FlowDataset:
    """row_id, features (scaled), label, category and split; ``columns`` names the feature positions.

    ``data`` is a Parquet table partitioned by split, so a read of one split touches only its files.
    """

    data: DataFrame
    columns: list[str]
    encoder: FlowEncoderModel
    scaler: VectorScaler

    def split(self, name: str) -> DataFrame:
        return self.data.where(F.col("split") == name)

    @classmethod
    def prepare(cls, capture: DataFrame, train: DataFrame, test: DataFrame, path: str | None = None,
                val_percent: int = 20, constant: str = "zero", strict_finite: bool = True) -> FlowDataset:
        """Domain and scale come from the capture; the training table is split into train and val by a hash of
        the row's columns; equal rows fall on the same side.

        Models need finite features, so here a -inf rate becomes 0 unless ``strict_finite`` is switched off.
        """
        spark = capture.sparkSession
        path = path or work_path(spark, "dataset")
        whole = clean_flows(capture, strict_finite)
        encoder = FlowEncoder(FEATURE_CATEGORICALS, [*NUMERIC_COLUMNS, "rate"]).fit(whole)
        scaler = VectorScaler.fit(encoder.transform(whole).select("features"), constant=constant)

        def ready(df: DataFrame) -> DataFrame:
            # the bucket follows from what the row says, so another layout of the files gives the same split
            marked = df.withColumn("_bucket", F.pmod(F.xxhash64(*df.columns, F.lit(1337)), F.lit(100)))
            cleaned = encoder.transform(clean_flows(marked, strict_finite))
            return scaler.transform(cleaned).select(
                "features", F.col("label").cast("int").alias("label"), category_number().alias("category"), "_bucket")

        numbered = ready(train).withColumn("row_id", F.monotonically_increasing_id())
        labelled = random_split(numbered, F.col("_bucket"), val_percent).drop("_bucket")
        tested = ready(test).drop("_bucket").withColumns({
            "row_id": F.monotonically_increasing_id() + F.lit(1 << 62), "split": F.lit("test"),
        })
        # row ids depend on the file layout of this read, so they are fixed by writing once
        labelled.unionByName(tested).write.mode("overwrite").partitionBy("split").parquet(path)
        return cls(spark.read.parquet(path), encoder.feature_names, encoder, scaler)

    @classmethod
    def load(cls, spark: SparkSession, capture: str, train: str, test: str, **options) -> FlowDataset:
        """From three CSV paths, each with a header. The capture is read several times, so it is staged as Parquet."""
        return cls.prepare(written(scan_labelled(spark, capture), "capture"), scan_labelled(spark, train),
                           scan_labelled(spark, test), **options)


def category_gaps(df: DataFrame) -> DataFrame:
    """Rows with neither a known attack name nor ``label = 0``; they get category code 0."""
    from flowlens.operators.encode import category_block

    return df.agg(F.count_if(F.array_max(category_block()) == 0).alias("rows_without_category"))


def plain_frame(df: DataFrame, big: DataFrame | None = None, onehot: bool = True, family: str = "all",
                strict_finite: bool = False) -> DataFrame:
    """The cleaned table as a user sees it: optionally one column family, one-hot against the domain of ``big``."""
    from flowlens.functions.cleaning import select_family

    cleaned = select_family(clean_flows(df, strict_finite), family)
    if onehot:
        text = {f.name for f in cleaned.schema.fields if f.dataType.typeName() == "string"}
        categorical = [c for c in cleaned.columns if c in text]
        numeric = [c for c in cleaned.columns if c not in text]
        reference = cleaned if big is None else select_family(clean_flows(big, strict_finite), family)
        cleaned = FlowEncoder(categorical, numeric).fit(reference).transform_wide(cleaned)
    return fill_nulls(cleaned)
