"""Token counts through a digest cache: only texts whose digest has no stored count are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tokens import encoder, forget, slices, tokenizer_digest
from flowlens.session import path_exists

CACHE_SCHEMA = "text_digest binary, tokenizer string, n_tokens long"


def text_digest() -> Column:
    """SHA-256 of the text as the tokenizer gets it: null counts as empty, all else is kept byte by byte."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, over: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; the counts of new texts go to ``cache``.

    ``cache`` is a Parquet folder that grows: its rows are found by text digest and tokenizer digest, so another version
    of the tokenizer never meets the old counts. Of the texts without a stored count, one for each digest is encoded,
    and the new counts are appended before the result is read. A failed run appends nothing; two runs that append the
    same digest at once do no harm, as equal digests have equal counts and count once.

    Copies are combined before the shuffle by digest, which moves one text for each digest and task. The file
    ``tokenizer`` must be at the same path on every machine.

    Defined cases: a null text is empty (0 bytes, 0 tokens); rows with the same doc_id or a null one are each counted;
    an empty table gives no rows and appends nothing; columns beyond doc_id and text are not read.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_digest", text_digest())

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache) if path_exists(spark, cache) else spark.createDataFrame([], CACHE_SCHEMA)
        return rows.where(F.col("tokenizer") == version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                counts = encoder(tokenizer).counts(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                    names=["text_digest", "tokenizer", "n_tokens"],
                )
        forget(tokenizer)

    one = base.groupBy("text_digest").agg(F.first("text").alias("text"))  # combined before the shuffle
    new = one.join(stored().select("text_digest"), "text_digest", "left_anti")
    new.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return base.select("doc_id", "text_digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).join(
        stored(), "text_digest"
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
