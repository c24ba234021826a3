"""Token ids as flat unsigned integer files with 64-bit document offsets, written and memory-mapped by tasks.

A data set is a folder of shards. Shard k holds the documents of the k-th range of doc_id:

* ``tokens-<k>-<attempt>.bin``: ids of all its documents, unsigned little-endian, 16 bits if the vocabulary allows, else 32;
* ``offsets-<k>-<attempt>.bin``: 64-bit unsigned positions of its n documents in the whole data set, and the end: n + 1;
* ``docs-<k>-<attempt>.bin``: 64-bit signed doc_ids, the smallest value for null;
* ``shards/``: a Parquet table that names the files of each shard. A file that it doesn't name is left from a lost attempt.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from flowlens.llm.tokens import encoder, give_back, slices
from flowlens.session import written

NO_ID = -(2**63)


def _create(folder: str, name: str):
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return fs.open_output_stream(f"{path}/{name}")


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file of the data set as an array: memory-mapped from a mounted folder, else read from the store."""
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        file = f"{where.path}/{name}"
        return np.memmap(file, kind, "r") if pafs.LocalFileSystem().get_file_info(file).size else np.zeros(0, kind)
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), kind)


@dataclass
class TokenFiles:
    """A written data set."""

    spark: SparkSession
    folder: str
    kind: str  # numpy type of an id

    def shards(self) -> DataFrame:
        """(shard, first, n_docs, n_ids, tokens, offsets, docs): first is the position of the shard's first id."""
        return self.spark.read.parquet(f"{self.folder}/shards")

    def documents(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
        folder, kind = self.folder, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids, offsets = mapped(folder, row["tokens"], kind), mapped(folder, row["offsets"], "<u8")
                    docs = mapped(folder, row["docs"], "<i8")
                    at = (offsets - offsets[0]).astype(np.int64)
                    for first in range(0, len(docs), 10_000):
                        own = range(first, min(first + 10_000, len(docs)))
                        sums = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in own]
                        ids_of = np.array(docs[own.start : own.stop])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids_of, pa.int64(), mask=ids_of == NO_ID), pa.array(offsets[own.start : own.stop].astype(np.int64)),
                            pa.array(np.diff(at[own.start : own.stop + 1])), pa.array(sums, pa.int64()),
                        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        shards = self.shards().where("n_docs > 0").select("shard", "tokens", "offsets", "docs")
        return shards.repartition(max(1, self.spark.sparkContext.defaultParallelism * 2), "shard").mapInArrow(
            run, "doc_id long, start long, n_tokens long, ids_crc32 long"
        )


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> TokenFiles:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order, ``end_id`` after each document, into ``folder``.

    Range partitions of doc_id are the shards; a task encodes its rows and appends them to its own file. The second pass
    adds the sizes of the shards before (a prefix sum over one row a shard) and writes the global offsets. A lost task is
    run again under other file names, and only the names that Spark commits with the task's rows are used.

    Defined cases: a null text is empty (only ``end_id``); null doc_ids come first; rows with the same doc_id are ordered
    by a hash of the text, equal rows are all written; an empty table gives no documents; other columns are not read.
    """
    spark = docs.sparkSession
    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 2**16 else "<u4"
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "tie", F.xxhash64("text")
    )
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"tokens-{shard:06d}-{uuid.uuid4().hex}.bin"
        at = 0
        with _create(folder, name) as out:
            for batch in batches:
                for part in slices(batch, 1):
                    ids, starts = encoder(tokenizer).encode(part.column(1))
                    out.write(np.insert(ids, starts[1:], end_id).astype(kind).tobytes())
                    n = np.diff(starts) + 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(n), shard, np.int64)), pa.array(at + np.arange(len(n))), part.column(0), pa.array(n),
                        pa.array([name] * len(n), pa.string()),
                    ], names=["shard", "place", "doc_id", "n", "tokens"])
                    at += len(n)
        encoder(tokenizer).forget()  # few of a shard's new words come again in the next one, and the worker goes on to other steps
        give_back()

    index = written(ordered.mapInArrow(encode, "shard long, place long, doc_id long, n long, tokens string"), "token-index")
    sizes = index.groupBy("shard", "tokens").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    bases = written(sizes.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-bases")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and place; a shard's files are closed when the next one begins."""
        shard, files, names = None, (), {}

        def close(last: int) -> pa.RecordBatch:
            files[0].write(np.array([last], "<u8").tobytes())
            for f in files:
                f.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, **names}], pa.schema([
                ("shard", pa.int64()), ("offsets", pa.string()), ("docs", pa.string())]))

        at = 0
        for batch in batches:
            shards = np.asarray(batch.column(0))
            cuts = np.concatenate([[0], np.nonzero(np.diff(shards))[0] + 1, [len(shards)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if shards[a] != shard:
                    if shard is not None:
                        yield close(at)
                    shard, mark = int(shards[a]), uuid.uuid4().hex
                    names = {"offsets": f"offsets-{shard:06d}-{mark}.bin", "docs": f"docs-{shard:06d}-{mark}.bin"}
                    files = tuple(_create(folder, x) for x in names.values())
                    at = batch.column(3)[a].as_py()
                n = np.asarray(batch.column(2))[a:b]
                ends = at + np.cumsum(n)
                files[0].write((ends - n).astype("<u8").tobytes())
                files[1].write(np.asarray(batch.column(1).slice(a, b - a).fill_null(NO_ID), "<i8").tobytes())
                at = int(ends[-1])
        if shard is not None:
            yield close(at)

    placed = index.join(bases.select("shard", "first"), "shard").repartition("shard").sortWithinPartitions("shard", "place")
    names = placed.select("shard", "doc_id", "n", "first").mapInArrow(lay_out, "shard long, offsets string, docs string")
    bases.join(names, "shard").write.parquet(f"{folder}/shards")
    return TokenFiles(spark, folder, kind)
