"""Toxicity by multiple-instance learning: sentences get scores, noisy-or makes them a document's, documents have labels.

A sentence's probability is the logistic of the weights of its words' hashed features; a document is toxic unless none of
its sentences is, 1 - prod(1 - p). Only documents are labelled; the gradient of the document's likelihood says how much
each sentence answers for it, so the fitted weights also tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from flowlens.llm.labels import first_by_hash, held_out
from flowlens.llm.words import hashed, plain, split_words
from flowlens.session import drop_written, written

#: Hashed features; labelled documents in the fit (of each label); tasks of a pass; passes over the sample.
WIDTH, SAMPLE, TASKS, PASSES = 2**17, 20_000, 8, 40
_RATE, _RIDGE, _PRIOR, _BIAS = 0.1, 1e-6, 10.0, -8.0
_BREAK = "\x01"


@dataclass
class Sentences:
    """Sentence s has the distinct words codes[starts[s]:starts[s + 1]], row r the sentences rows[r]:rows[r + 1].
    ``grams[c]`` holds the features of the word c."""

    codes: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    grams: np.ndarray

    def sums(self, word_values: np.ndarray) -> np.ndarray:
        """Sum over each sentence's words."""
        total = np.concatenate([[0.0], np.cumsum(word_values[self.codes])])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def log_clean(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each sentence its probability, of each row the logarithm of none of its sentences being toxic."""
        z = np.clip(bias + self.sums(weights[self.grams].sum(axis=1)), -40, 40)
        total = np.concatenate([[0.0], np.cumsum(-np.logaddexp(0, z))])
        return 1 / (1 + np.exp(-z)), total[self.rows[1:]] - total[self.rows[:-1]]


def sentences(texts: pa.Array) -> Sentences:
    """Sentences end with . ! ? or a line feed; words are lower-cased runs of letters and digits. Features of a word are
    itself and its first four and five letters. Every row has at least one sentence, which may have no words."""
    texts = plain(texts)
    texts = pc.replace_substring_regex(texts, r"[.!?\n\x01]+", f" {_BREAK} ")
    texts = pc.replace_substring_regex(texts, r"[\x00\x02-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    words = split_words(pc.utf8_lower(texts))
    mark = pc.index(words.words, _BREAK).as_py()
    row = np.repeat(np.arange(len(texts)), words.sizes())
    ends = words.codes == mark if mark >= 0 else np.zeros(len(words.codes), bool)
    kept = ~ends
    number = np.cumsum(ends) + row  # grows by one at each mark and each row
    count = np.bincount(row[ends], minlength=len(texts)) + 1
    rows = np.concatenate([[0], np.cumsum(count)])
    many = len(words.words) + 1
    once = np.unique(number[kept].astype(np.int64) * many + words.codes[kept])  # a word counts once in a sentence
    starts = np.searchsorted(once // many, np.arange(rows[-1] + 1))
    vocabulary = words.words
    grams = np.stack([
        (hashed(pc.utf8_slice_codeunits(vocabulary, 0, stop) if stop else vocabulary) + np.uint64(i)) % np.uint64(WIDTH)
        for i, stop in enumerate((0, 4, 5))
    ], axis=1).astype(np.int32) if len(vocabulary) else np.zeros((0, 3), np.int32)
    return Sentences(once % many, starts, rows, grams)


@dataclass
class ToxicModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        _, clean = sentences(texts).log_clean(self.weights, self.bias)
        return -np.expm1(clean)


_BATCH = "y binary, codes binary, starts binary, rows binary, grams binary"


def _batches(docs: DataFrame) -> DataFrame:
    """The documents (text, y) as number arrays, a thousand to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                s = sentences(part.column(0))
                arrays = (np.asarray(part.column(1)).astype(np.float64), s.codes.astype(np.int32), s.starts, s.rows, s.grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["y", "codes", "starts", "rows", "grams"]
                )

    return docs.select("text", "y").mapInArrow(run, _BATCH)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Sentences]]:
    for row in batch.to_pylist():
        yield np.frombuffer(row["y"], np.float64), Sentences(
            np.frombuffer(row["codes"], np.int32), np.frombuffer(row["starts"], np.int64), np.frombuffer(row["rows"], np.int64),
            np.frombuffer(row["grams"], np.int32).reshape(-1, 3),
        )


def _summed(sample: DataFrame, fold) -> tuple[np.ndarray, float]:
    """The sum over the batches of ``fold(y, sentences)`` -> (vector of WIDTH, number); each task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, number = np.zeros(WIDTH), 0.0
        for batch in batches:
            for y, s in _unpacked(batch):
                v, n = fold(y, s)
                vector += v
                number += n
        yield pa.RecordBatch.from_arrays([pa.array([vector.tobytes()], pa.binary()), pa.array([number])], names=["v", "n"])

    rows = sample.mapInArrow(run, "v binary, n double").collect()  # as many rows as tasks, each of WIDTH numbers
    return sum((np.frombuffer(r.v) for r in rows), np.zeros(WIDTH)), sum(r.n for r in rows)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1), held-out documents left out.

    Of each label the ``SAMPLE`` labelled documents that come first by a hash of doc_id are used, a bounded list of ids that
    is broadcast, so texts are not shuffled before. Weights begin at shrunken log ratios of document counts and
    follow the gradient of the noisy-or likelihood (Adam, ``PASSES`` passes). They stay at 0 or above: words are evidence
    for toxicity or none, so harmless words around an offending one don't outweigh it. Without labels of both kinds every text
    scores nearly 0.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(5))
    ids = first_by_hash(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")), SAMPLE).select("doc_id", "y")
    ids = written(ids, "labelled")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    sample = written(_batches(texts.repartition(TASKS, "doc_id")), "sentences")
    sample = sample.coalesce(TASKS)
    counts = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    weights, bias = np.zeros(WIDTH), _BIAS
    if len(counts) == 2:
        def present(label: float):
            def fold(y: np.ndarray, s: Sentences) -> tuple[np.ndarray, float]:
                row = np.repeat(np.repeat(np.arange(len(y)), np.diff(s.rows)), np.diff(s.starts))
                inside = (y == label)[row]
                pair = np.unique(row[inside, None].astype(np.int64) * WIDTH + s.grams[s.codes[inside]].astype(np.int64))
                return np.bincount(pair % WIDTH, minlength=WIDTH).astype(float), float((y == label).sum())
            return fold

        toxic, n1 = _summed(sample, present(1.0))
        other, n0 = _summed(sample, present(0.0))
        share = n1 / max(n1 + n0, 1)
        ratio = (toxic + _PRIOR * share) / (other + _PRIOR * (1 - share)) * n0 / max(n1, 1)
        weights = np.maximum(np.log(ratio), 0.0)
        first, second = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        balance = min(10.0, n0 / max(n1, 1)) ** 0.5
        for step in range(1, PASSES + 1):
            def fold(y: np.ndarray, s: Sentences, weights=weights, bias=bias) -> tuple[np.ndarray, float]:
                p, clean = s.log_clean(weights, bias)
                dirty = np.maximum(-np.expm1(clean), 1e-12)
                pull = np.where(y == 1, -balance * np.exp(clean) / dirty, 1.0)
                own = p * np.repeat(pull, np.diff(s.rows))  # gradient by each sentence's logit
                per_word = np.bincount(s.codes, np.repeat(own, np.diff(s.starts)), len(s.grams))
                return np.bincount(s.grams.ravel(), np.repeat(per_word, 3), WIDTH), float(own.sum())

            slope, slope0 = _summed(sample, fold)
            gradient = np.append(slope / (n0 + n1) + _RIDGE * weights, slope0 / (n0 + n1))
            first = 0.9 * first + 0.1 * gradient
            second = 0.99 * second + 0.01 * gradient**2
            move = _RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
            weights, bias = np.maximum(weights - move[:-1], 0.0), bias - move[-1]
    drop_written(ids)
    return ToxicModel(weights, bias)


def _model(docs: DataFrame, labels: DataFrame):
    """Broadcast: WIDTH numbers, whatever the input."""
    return docs.sparkSession.sparkContext.broadcast(fit(docs, labels))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), learned from ``labels``.

    Defined cases: a null or wordless text has one sentence without words and the bias as its score; a null doc_id has
    no label and is not held out; of several labels of a document the toxic one counts; an empty table gives no rows;
    other columns are not read.
    """
    model = _model(docs, labels)

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        parts = [model.value.scores(text.slice(at, 1000)) for at in range(0, len(text), 1000)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    scored = docs.select("doc_id", held_out(5).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """(doc_id, sentence, text, score): the sentences, counted from 0, with a probability of ``at`` or more."""
    model = _model(docs, labels)
    kind = ArrayType(StructType([StructField("sentence", LongType()), StructField("text", StringType()), StructField("score", DoubleType())]))

    @F.arrow_udf(kind)
    def located(text: pa.Array) -> pa.Array:
        out = []
        for start in range(0, len(text), 1000):
            part = text.slice(start, 1000)
            s = sentences(part)
            p, _ = s.log_clean(model.value.weights, model.value.bias)
            for r, whole in enumerate(part.to_pylist()):
                own = p[s.rows[r] : s.rows[r + 1]]
                found = np.nonzero(own >= at)[0]
                pieces = pc.split_pattern_regex(pa.array([whole or ""]), r"[.!?\n\x01]+")[0].as_py() if len(found) else []
                out.append([{"sentence": int(i), "text": pieces[i].strip(), "score": float(own[i])} for i in found])
        return pa.array(out, pa.list_(pa.struct([("sentence", pa.int64()), ("text", pa.string()), ("score", pa.float64())])))

    rows = docs.select("doc_id", F.explode(located(F.col("text").cast("string"))).alias("s"))
    return rows.select("doc_id", "s.sentence", "s.text", "s.score")
