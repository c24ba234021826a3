"""A training corpus in five stages: good documents, one of each near-duplicate group, none that holds benchmark passages,
mixed to source weights, written as token ids.

Each stage gets the documents its predecessor kept and returns those it keeps, with all columns; the last one writes the
token files and returns their index. Tables other than documents are read from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import decontaminate, minhash, mixing, quality, token_file
from flowlens.session import drop_written, work_path, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, accepts."""
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id."""
    groups = minhash.near_duplicates(docs, shingle=5, percent=80)
    kept = groups.where("kept").select(F.col("doc_id").alias("kept id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept id")), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without occurrences of benchmark windows, or with few hit words for their length."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, also not at all."""
    return mixing.mixed(docs, weights=(5, 2, 1), percent=150, cap=2)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the token files, read back from them."""
    files = token_file.write_tokens(
        docs, public_tokenizers.path("word_bpe_49k.json"), work_path(spark, "token-file"), end_id=1
    )
    return files.documents()


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_first_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]

#: The fitted classifier of the first stage has no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet before the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        if last is not None:
            drop_written(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
