"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Fixed base rules come first. Beyond them every statistic has a list of cutoffs; the strictest one is used of which labelled
good documents prove, by an exact binomial bound, that it rejects few good documents of the stratum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.session import written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: (numerator, denominator) of each statistic: a document is rejected if 100 * numerator > cutoff * denominator.
STATISTICS = {
    "symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "exclamations": ("n_exclamations", "n_words"),
    "neighbours": ("n_neighbours", "n_words"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines"),
}
CUTOFFS = (50, 40, 30, 20, 15, 10, 7, 5, 3, 2, 1)


@dataclass(frozen=True)
class Risk:
    """No more than ``rejected`` of a stratum's good documents fall to all statistics together, but for a chance of ``error``
    over all strata, statistics and cutoffs."""

    rejected: float = 0.06
    error: float = 0.05


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where lambdas use it for every element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside runs of ``WINDOW`` words that occur twice or more. Runs are told apart by a 64-bit hash."""
    def covered(sorted_places: Column) -> Column:
        n = F.size(sorted_places)
        step = F.transform(sorted_places, lambda x, k: F.when(k == n - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(sorted_places, k + 1) - x)))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    def repeated(runs: Column) -> Column:
        last = F.size(runs) - 1
        same = lambda k, s: F.coalesce(F.get(runs, k)["h"] == s["h"], F.lit(False))
        marked = F.transform(runs, lambda s, k: F.when(((k > 0) & same(k - 1, s)) | ((k < last) & same(k + 1, s)), s["i"]).otherwise(-1))
        return let(F.sort_array(F.filter(marked, lambda i: i >= 0)), covered)

    def counted(hashes: Column) -> Column:
        runs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(runs, repeated))

    def hashed(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < WINDOW, 0).otherwise(
            let(F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WINDOW))), counted)
        )

    return let(words, hashed)


def statistics(docs: DataFrame, stratum: str) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_exclamations,
    n_neighbours, n_lines) for every row of ``docs``. A null text has no words and no lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    by_words = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(F.transform(w, lambda x, k: (k > 0) & (F.get(w, k - 1) == x)), lambda same: same)).alias("n_neighbours"),
    ))[0]
    by_lines = F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))[0]
    wide = docs.select(
        "doc_id", F.col(stratum).alias("stratum"), by_words.alias("w"), by_lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"), without("#*$%&|<>").alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"), without("!").alias("n_exclamations"),
    )
    return wide.select("doc_id", "stratum", *(F.col(c).cast("long").alias(n) for c, n in (
        ("w.n_words", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("l.dup", "n_dup_lines"),
        ("w.n_repeat_words", "n_repeat_words"), ("n_capitals", "n_capitals"), ("n_exclamations", "n_exclamations"),
        ("w.n_neighbours", "n_neighbours"), ("l.n", "n_lines"),
    )))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n and p, exact but for rounding; 1 where k >= n * p, which no bound asks for."""
    odds = math.log(p / (1 - p))

    def add(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    first = n * F.lit(math.log1p(-p))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(first.alias("term"), F.exp(first).alias("total")), add, lambda state: state["total"])
    return F.when(k < n * F.lit(p), total).otherwise(1.0)


def thresholds(stats: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, statistic, cutoff): the strictest cutoff that passes, absent where none does.

    Good documents of the labels are the holdout: cutoffs are fixed beforehand, so none was chosen by looking at them. A
    cutoff passes if, were the share of good documents it rejects ``risk.rejected`` / statistics, seeing so few rejected
    would have a chance of no more than ``risk.error`` / (strata * statistics * cutoffs), the Bonferroni correction.
    """
    good = stats.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    # one sum for each statistic and cutoff, so a document stays one row
    names = [(name, c) for name in STATISTICS for c in CUTOFFS]
    sums = good.groupBy("stratum").agg(F.count("*").alias("n"), *(
        F.count_if(100 * F.col(STATISTICS[name][0]) > c * F.col(STATISTICS[name][1])).alias(f"k{i}") for i, (name, c) in enumerate(names)
    ))
    cells = sums.select("stratum", "n", F.explode(F.array(*(
        F.struct(F.lit(name).alias("statistic"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (name, c) in enumerate(names)
    ))).alias("cell")).select("stratum", "n", "cell.*")
    strata = good.select("stratum").distinct().agg(F.count("*").alias("strata"))
    level = F.lit(risk.error / len(names)) / F.col("strata")
    tail = binomial_tail(F.col("n"), F.col("k"), risk.rejected / len(STATISTICS))
    passed = cells.join(F.broadcast(strata)).where(tail <= level)  # one row, a number
    return passed.groupBy("stratum", "statistic").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of ``docs``.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated runs of 8. kept: not base_failed, and no
    statistic beyond the cutoff that its stratum has for it. Statistics are worked out once and written; the cutoffs are
    a table of one row a stratum.

    Defined cases: a null text has no words and fails; a null stratum is a stratum; documents without a label only get
    judged, labels without a document are left out; without labels no cutoff passes and only the base rules reject; rows
    with the same doc_id are judged one by one; an empty table gives no rows; other columns are not read.
    """
    stats = written(statistics(docs, stratum), "statistics")
    cuts = thresholds(stats, labels, risk).groupBy(F.col("stratum").alias("of")).agg(*(
        F.min(F.when(F.col("statistic") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in STATISTICS
    ))
    cuts = written(cuts, "cutoffs")
    beyond = F.lit(False)
    for name, (a, b) in STATISTICS.items():
        beyond = beyond | F.coalesce(100 * F.col(a) > F.col(f"cut_{name}") * F.col(b), F.lit(False))
    out = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("base_failed", base_failed())
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept")
    )
