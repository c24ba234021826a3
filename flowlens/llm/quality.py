"""Quality classifier: a Bradley-Terry ranking learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from flowlens.llm.labels import first_by_hash, held_out
from flowlens.llm.tokens import runs
from flowlens.llm.words import plain, row_sums, split_words
from flowlens.session import drop_written, written

#: Labelled documents of each label in the fit, and pairs for each of them: the bounds of the fitted sample.
SAMPLE, PAIRS = 20_000, 4
#: Text bytes that are measured at a time.
PIECE_BYTES = 2_000_000
#: The score at the cut between the labels.
CUT = 0.3
SHARES = ("distinct words", "repeated neighbours", "capitals", "odd marks", "exclamations", "bars", "digits", "other marks", "repeated lines")
_CLASSES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "odd marks": b"#*$%&|<>", "exclamations": b"!", "bars": b"|",
            "digits": b"0123456789", "other marks": b".,;:?'\"()-"}
WIDTH = 2 * len(SHARES) + 2


def _repeats(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """For each row: entries equal to an earlier one of the same row."""
    pair = np.unique(rows * (int(codes.max(initial=0)) + 1) + codes)
    return np.bincount(rows, minlength=n) - np.bincount(pair // (int(codes.max(initial=0)) + 1), minlength=n)


def measured(texts: pa.Array) -> np.ndarray:
    """A row of ``WIDTH`` features for each text: shares and their roots, size, word length. All 0 without words."""
    texts = plain(texts)
    words, n = split_words(texts), len(texts)
    sizes = words.sizes()
    rows = np.repeat(np.arange(n), sizes)
    some = np.maximum(sizes, 1)
    share = {"distinct words": np.where(sizes > 0, 1 - _repeats(rows, words.codes.astype(np.int64), n) / some, 0)}
    same = (words.codes[1:] == words.codes[:-1]) & (rows[1:] == rows[:-1])
    share["repeated neighbours"] = np.bincount(rows[1:][same], minlength=n) / some
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or pa.py_buffer(b""), np.uint8)[offsets[0] : offsets[-1]]
    at, length = offsets - offsets[0], np.maximum(np.diff(offsets), 1)
    for name, members in _CLASSES.items():
        inside = np.isin(np.arange(256), np.frombuffer(members, np.uint8))
        share[name] = row_sums(inside[data].astype(np.int64), at) / length
    lines = pc.split_pattern(texts, "\n")
    line, starts = lines.flatten().dictionary_encode(), np.asarray(lines.offsets, np.int64)
    line_rows, line_codes = np.repeat(np.arange(n), np.diff(starts)), np.asarray(line.indices, np.int64)
    full = np.asarray(pc.match_substring_regex(line.dictionary, r"[^\x20\x09-\x0D]"), bool)[line_codes] if len(line_codes) else np.zeros(0, bool)
    counted = np.maximum(np.bincount(line_rows[full], minlength=n), 1)
    share["repeated lines"] = _repeats(line_rows[full], line_codes[full], n) / counted
    base = np.stack([share[k] for k in SHARES], axis=1)
    letters = np.where(sizes > 0, np.diff(offsets) / some, 0)
    return np.concatenate([base, np.sqrt(base), np.log1p(sizes)[:, None], np.log1p(letters)[:, None]], axis=1)


@F.arrow_udf(ArrayType(DoubleType()))
def features(text: pa.Array) -> pa.Array:
    parts = [measured(text.slice(at, n)) for at, n in runs([text], PIECE_BYTES)] or [np.zeros((0, WIDTH))]
    matrix = np.concatenate(parts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * WIDTH), pa.array(matrix.ravel()))


@dataclass
class RankModel:
    """score = logistic(slope * (weights . features - cut) + logit(CUT)), so it is at least ``CUT`` from the cut on."""

    weights: list[float]
    cut: float
    slope: float

    def raw(self, values: Column) -> Column:
        return sum((values[i] * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, values: Column) -> Column:
        z = F.lit(self.slope) * (self.raw(values) - F.lit(self.cut)) + F.lit(math.log(CUT / (1 - CUT)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def fit(measured_docs: DataFrame, labels: DataFrame) -> RankModel:
    """Learn from (doc_id, x) and (doc_id, quality); quality is 1 or 0, rows with another value or none are left out.

    Each document of the sample meets ``PAIRS`` documents of the other label: the k-th one in hash order meets places
    of the other list that shift from round to round. A logistic regression without intercept on feature differences is
    the Bradley-Terry likelihood. The cut is the quantile of the scores of all labelled rows, not only of the sample, at the
    share of label 0 among them, so as many are rejected as are known to be bad. With one label only, or none, nothing is rejected.
    """
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    rows = measured_docs.where(~held_out(5)).join(known, "doc_id").select("doc_id", "y", "x")
    picked = written(first_by_hash(rows, SAMPLE), "ranked")
    count = {r.y: r.n for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        drop_written(picked)
        return RankModel([0.0] * WIDTH, -1.0, 1.0)
    more, less = (1, 0) if count[1] >= count[0] else (0, 1)
    few = count[less]
    left = picked.where(F.col("y") == more).select(
        F.col("x").alias("p"), "place", F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1))).alias("round")
    ).withColumn("of", F.pmod(F.col("place") + F.col("round") * F.lit(few // PAIRS + 1), F.lit(few)))
    right = picked.where(F.col("y") == less).select(F.col("x").alias("q"), F.col("place").alias("of"))
    sign = F.when(F.col("place") % 2 == 0, 1.0).otherwise(-1.0)
    pairs = left.join(right, "of").select(
        array_to_vector(F.zip_with("p", "q", lambda a, b: (a - b) * sign)).alias("features"),
        (sign * (1.0 if more == 1 else -1.0) > 0).cast("double").alias("label"),
    )
    pairs = written(pairs, "pairs")
    fitted = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=60, tol=1e-6).fit(pairs)
    weights = [float(w) for w in fitted.coefficients]
    raw = RankModel(weights, 0.0, 1.0).raw(F.col("x"))
    known_scores = written(rows.select("y", raw.alias("s")).groupBy("s", "y").agg(F.count("*").alias("n")), "scores")
    every = {r.y: r.n for r in known_scores.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    below, above = _around(known_scores, every[0])
    cut = (above + below) / 2
    # in the sample both labels get the weight they have among all labelled documents
    scored = written(picked.select("y", raw.alias("s")), "scores")
    share = {y: every[y] / (every[0] + every[1]) / count[y] for y in (0, 1)}
    platt = LogisticRegression(maxIter=60, regParam=1e-4, weightCol="w").fit(scored.select(
        array_to_vector(F.array(F.col("s") - F.lit(cut))).alias("features"), F.col("y").cast("double").alias("label"),
        F.when(F.col("y") == 0, share[0]).otherwise(share[1]).alias("w"),
    ))
    drop_written(picked, pairs, scored, known_scores)
    return RankModel(weights, float(cut), max(float(platt.coefficients[0]), 1e-6))


def _around(scores: DataFrame, rank: int) -> tuple[float, float]:
    """The ``rank``-th and the next smallest score of (s, n), n rows of score s; there are more than ``rank`` rows.

    Scores are dealt by range and counted for each part; only the parts that hold the two ranks are looked into.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = scores.groupBy("s").agg(F.sum("n").alias("n"))
    ranged = written(merged.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id()), "scores")
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, offset = 0, {}
    for part, n in sizes:
        if before < rank + 1 and before + n >= rank:
            offset[part] = before
        before += n
    start = F.lit(0)
    for part, n in offset.items():
        start = F.when(F.col("part") == part, F.lit(n)).otherwise(start)
    so_far = F.sum("n").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    upto = ranged.where(F.col("part").isin(list(offset))).withColumn("upto", start + so_far)
    found = [upto.where(F.col("upto") >= k).agg(F.min("s")).first()[0] for k in (rank, rank + 1)]
    drop_written(ranged)
    return found[0], found[1]


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), learned from ``labels``.

    Features come from the text alone. They are measured once for all documents and written; only ids and features meet
    the labels, texts are never shuffled.

    Defined cases: a null or wordless text has all features 0 and is scored like any other; a null doc_id is in no fold
    that is held out and has no label; several labels of a document all count; without labels every score is that of
    an equal rank, above the cut; an empty table gives no rows; other columns are not read.
    """
    x = written(docs.select("doc_id", features(F.col("text").cast("string")).alias("x")), "features")
    model = fit(x, labels)
    score = model.score(F.col("x"))
    return x.select("doc_id", held_out(5).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns kept."""
    x = written(docs.select("doc_id", features(F.col("text").cast("string")).alias("x")), "features")
    model = fit(x, labels)
    drop_written(x)
    return docs.where(model.score(features(F.col("text").cast("string"))) >= CUT)
