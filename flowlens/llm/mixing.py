"""Mixing sources to target weights by entropy balancing.

Rates r of documents are sought that stay close to one and meet token targets: minimise the sum of r log r - r + 1 over the
documents of a source, subject to the sum of size * r being the source's target and the sum of r being its share of
documents, with r <= cap. That share makes the mean size of the documents taken of every source the one of the whole table, as
far as the cap lets it (see ``wanted_lengths``), so that sources differ less in length. The dual is convex, its solution tilts
exponentially, r = min(cap, exp(a + b * size)), and Newton's method finds (a, b) of every source at once from a table of document
sizes. Rates are then rounded into copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import drop_written, written

#: Rounding moves at most this share of a source's documents (or one document) away from the sum of their rates.
TRIM = 0.01
#: Equal-sized documents of a source are ranked in pieces of about so many at most.
PIECE = 256
_STEPS, _CLOSE = 60, 1e-6
#: The mean size of a source's documents moves at most so far towards the furthest one that its target and the cap allow.
PULL = 0.25


def n_words() -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], percent: int, cap: float) -> DataFrame:
    """(source, source_size, n_docs, target): the sources in code point order, null last, weigh ``weights`` in turn.

    They share ``percent`` of all sizes by weight; a target stops at ``cap`` times its source's size and the excess goes
    to the others by weight. That is target = min(cap * size, level * weight) at the level that uses everything up: with
    sources ordered by the level at which they stop, those before the solution are full.
    One row a source goes through the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1))
    room = F.col("source_size") * F.lit(float(cap))
    stops = Window.orderBy(F.col("room") / F.col("weight"), "source")
    everything = Window.partitionBy()
    per = (
        per.withColumn("room", room)
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(percent / 100.0))
        .withColumn("full", F.coalesce(F.sum("room").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(stops.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
        # the level is right from the first source that it doesn't fill
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("room"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct("full", "level"))).over(everything)["level"])
    )
    return per.select(
        "source", "source_size", "n_docs", F.coalesce(F.least("room", F.col("level") * F.col("weight")), F.col("room")).alias("target")
    )


def wanted_lengths(table: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``targets`` with ``length``, the wanted mean size of each source's documents against today's; null without words.

    ``table`` has (source, size, n). A target is met by the fewest documents if the largest come first, each ``cap`` times,
    and by the most if the smallest do. The wanted number is the one that gives the mean size of all documents with words,
    or else ``PULL`` of the way from the number at equal rates to the fewest or most: a source never needs all its room.
    One row for each size of a source goes through the windows.
    """
    goals = targets.select(F.col("source").alias("of"), "target")
    words, everything = F.col("size") * F.col("n") * F.lit(cap), Window.partitionBy()

    def needed(order: Column) -> Column:
        before = F.sum(words).over(Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        left = F.col("target") - F.coalesce(before, F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / words)) * F.col("n") * F.lit(cap)

    per = table.join(goals, F.col("source").eqNullSafe(F.col("of"))).select(
        "source", "target", "size", "n", needed(F.desc("size")).alias("few"), needed(F.asc("size")).alias("many")
    ).groupBy(F.col("source").alias("same")).agg(
        F.sum("few").alias("few"), F.sum("many").alias("many"), F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("words"),
        F.first("target").alias("goal"))
    # one row a source
    mean = F.sum("words").over(everything) / F.sum("docs").over(everything)
    equal = F.col("docs") * F.col("goal") / F.col("words")
    limit = [equal + F.lit(PULL) * (F.col(end) - equal) for end in ("few", "many")]
    number = F.greatest(limit[0], F.least(limit[1], F.col("goal") / mean))
    return targets.join(per.select("same", (equal / number).alias("length")), F.col("source").eqNullSafe(F.col("same")), "left").drop("same")


def balanced_rates(sizes: DataFrame, targets: DataFrame, cap: float, length: float | None = None) -> DataFrame:
    """(source, a, b): the tilt of every source; ``length`` is the wanted mean size of its documents against today's, by default
    that of ``wanted_lengths``. A source whose tilt isn't found keeps its mean size: all its documents have the same rate.

    One step is one aggregation of the table (source, size, n) of equal documents, so documents are counted once. The
    sizes of a source are divided by their mean to keep both unknowns of one order. Only the largest gap of all
    sources comes to the driver.
    """
    table = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")).where("size > 0"), "sizes")
    targets = wanted_lengths(table, targets, cap) if length is None else targets.withColumn("length", F.lit(length))
    goals = targets.where("source_size > 0").select(
        "source", "target", "source_size", "length", (F.col("source_size") / F.col("n_docs")).alias("unit"),
        (F.col("target") >= F.col("source_size") * cap).alias("full"),
    )
    counts = table.groupBy(F.col("source").alias("same")).agg(F.sum("n").alias("n_sized"))
    start = goals.join(counts, F.col("source").eqNullSafe(F.col("same"))).drop("same")
    same = F.log(F.col("target") / F.col("source_size"))  # equal rates
    zero = {"a": same, "a0": same, **{name: F.lit(0.0) for name in ("b", "da", "db", "b0")}}
    far = {name: F.lit(float("inf")) for name in ("gap", "value")}
    state = written(start.withColumns({**zero, **far}), "tilts")
    for _ in range(_STEPS):
        moved = written(_newton(table, state, cap), "tilts")
        drop_written(state)
        state = moved
        if (state.where("NOT full").agg(F.max("gap")).first()[0] or 0.0) <= _CLOSE:
            break
    found = F.col("gap") <= _CLOSE
    out = written(state.select(
        "source", F.when(found, F.col("a")).otherwise(same).alias("a"), F.when(found, F.col("b")).otherwise(0.0).alias("b"), "full"), "tilts")
    drop_written(table, state)
    return out


def _newton(table: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """One step of every source from its trial point (a, b); (a0, b0) is the last accepted point, ``value`` the dual there,
    (da, db) the step that led to the trial point. A trial point where the dual is not lower is given up for one half as
    far. Without the cap the dual is smooth; the cap makes it linear beyond, which full steps would jump across."""
    x = F.col("size") / F.col("unit")
    tilt = F.least(F.col("a") + F.col("b") * x, F.lit(50.0))
    capped, log_cap = tilt >= math.log(cap), F.lit(math.log(cap))
    rate, free = F.when(capped, F.lit(cap)).otherwise(F.exp(tilt)), F.when(capped, 0.0).otherwise(F.exp(tilt))
    sums = (
        table.withColumnRenamed("source", "same").join(state, F.col("source").eqNullSafe(F.col("same"))).groupBy("same").agg(
            F.sum(F.col("n") * F.when(capped, cap + cap * (tilt - log_cap)).otherwise(F.exp(tilt))).alias("dual"),
            F.sum(F.col("n") * rate).alias("g0"), F.sum(F.col("n") * rate * x).alias("g1"), F.sum(F.col("n") * free).alias("h00"),
            F.sum(F.col("n") * free * x).alias("h01"), F.sum(F.col("n") * free * x * x).alias("h11"),
            F.countDistinct("size").alias("kinds"),
        )
    )
    want = F.col("target") / F.col("unit")  # of tokens, in mean documents
    docs = F.col("n_sized") * F.col("target") / F.col("source_size") / F.col("length")
    at = state.join(sums, F.col("source").eqNullSafe(F.col("same"))).drop("same")
    at = at.withColumn("docs", F.when(F.col("kinds") > 1, docs)).withColumn("want", want)  # documents of one size: tokens alone
    at = at.withColumn("now", F.col("dual") - F.coalesce(F.col("a") * F.col("docs"), F.lit(0.0)) - F.col("b") * F.col("want"))
    at = at.withColumn("now", F.when(F.col("kinds") > 1, F.col("now")).otherwise(F.col("dual") - F.col("a") * F.col("want")))
    at = at.withColumn("better", F.col("now") <= F.col("value"))
    p, q = F.col("docs") - F.col("g0"), F.col("want") - F.col("g1")
    ridge = F.lit(1e-9) * (F.col("docs") + F.col("want"))  # where all are capped, only this is left
    h00, h11, h01 = F.col("h00") + ridge, F.col("h11") + ridge, F.col("h01")
    det = h00 * h11 - h01 * h01
    one = F.col("docs").isNull()
    da = F.when(one, q / (h01 + F.lit(1e-9) * F.col("want"))).otherwise((h11 * p - h01 * q) / det)
    db = F.when(one, 0.0).otherwise((h00 * q - h01 * p) / det)
    at = at.withColumns({"na": da, "nb": db, "off": F.abs(q) / F.col("want") + F.coalesce(F.abs(p) / F.col("docs"), F.lit(0.0))})
    reach = F.greatest(F.lit(1.0), F.abs("na"), F.abs("nb"))
    at = at.withColumns({
        "da": F.when(F.col("better"), F.col("na") / reach).otherwise(F.col("da") / 2),
        "db": F.when(F.col("better"), F.col("nb") / reach).otherwise(F.col("db") / 2),
        "a0": F.when(F.col("better"), F.col("a")).otherwise(F.col("a0")),
        "b0": F.when(F.col("better"), F.col("b")).otherwise(F.col("b0")),
        "value": F.when(F.col("better"), F.col("now")).otherwise(F.col("value")),
    })
    done = F.col("full") | (F.col("off") <= _CLOSE)
    return at.select(
        "source", "target", "source_size", "length", "unit", "full", "n_sized",
        F.when(done, F.col("a")).otherwise(F.col("a0") + F.col("da")).alias("a"),
        F.when(done, F.col("b")).otherwise(F.col("b0") + F.col("db")).alias("b"),
        "da", "db", "a0", "b0", "value", F.when(F.col("full"), 0.0).otherwise(F.col("off")).alias("gap"),
    )


def _unit_hash(*columns: str) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(2**53))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source).

    size is the number of words, target what the row's source should give, taken the words the mix takes of this row:
    copies * size. No more than ``cap`` copies are taken.

    Every document gets the whole part of its rate or one more. How many of the documents of one source and size get
    one more is decided from the largest size on, by the words the rates still owe (see ``dealt``); which of them, by
    a hash. So each range of sizes gets copies as its rates say, and a source ends within about one of its shortest
    documents of its target. Hashes make reruns agree; rates are rounded to nine places, as sums of doubles may differ
    beyond. Sources and groups of one size may be large: only counts of a source come together, documents are ranked in pieces.

    Defined cases: a null or wordless text has size 0 and takes nothing; a null source is a source, the last one; a source
    without words has target 0; rows with the same doc_id are separate documents, told apart by size only, and equal
    rows may get copies that differ by one; an empty table gives no rows; other columns are not read.
    """
    sizes = written(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"))
        .withColumn("u", _unit_hash("doc_id", "size")), "mix-sizes"
    )
    targets = written(source_targets(sizes, weights, percent, cap), "mix-targets")
    tilts = balanced_rates(sizes, targets, float(cap))
    goals = targets.join(tilts.withColumnRenamed("source", "same"), F.col("source").eqNullSafe(F.col("same")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "a", "b", "full", (F.col("source_size") / F.col("n_docs")).alias("unit")
    )
    rated = sizes.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn(
        "rate", F.when(F.col("size") == 0, 0.0).when(F.col("full"), float(cap))
        .otherwise(F.least(F.lit(float(cap)), F.round(F.exp(F.col("a") + F.col("b") * F.col("size") / F.col("unit")), 9)))
    )
    rated = written(rated.select("doc_id", "source", "size", "source_size", "target", "rate", "u"), "mix-rates")
    sized = rated.where("size > 0")
    large = written(
        sized.groupBy(F.col("source").alias("of"), F.col("size").alias("long")).agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
        .where("pieces > 1"), "mix-pieces"
    )
    piece = F.coalesce(F.floor(F.col("u") * F.col("pieces")), F.lit(0)).cast("long")
    pieced = sized.join(large, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("long")), "left")
    pieced = pieced.withColumn("piece", piece).drop("of", "long", "pieces")
    groups = pieced.groupBy("source", "size", "piece").agg(F.count("*").alias("n"), F.max("rate").alias("rate"))
    extra = written(
        groups.withColumn("start", _unit_hash("source")).groupBy("source")
        .applyInPandas(dealt, "of string, long long, part long, more long"), "mix-extra"
    )
    ranks = Window.partitionBy("source", "size", "piece").orderBy("u", "doc_id")
    rounded = (
        pieced.withColumn("place", F.row_number().over(ranks))
        .join(extra, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("long")) & (F.col("piece") == F.col("part")))
        .withColumn("copies", F.floor("rate") + (F.col("place") <= F.col("more")).cast("long"))
    )
    names = ["doc_id", "size", "source_size", "target", "rate", "copies"]
    out = written(
        rounded.select(*names).unionByName(rated.where("size = 0").withColumn("copies", F.lit(0).cast("long")).select(*names))
        .withColumn("taken", F.col("copies") * F.col("size")), "mix"
    )
    drop_written(sizes, targets, tilts, rated, large, extra)
    return out


def dealt(groups: pd.DataFrame) -> pd.DataFrame:
    """(of, long, part, more): how many of the ``n`` documents of each size and piece of a source get one copy more than
    the whole part of their rate.

    From the largest size on, each group takes as many as the words owed so far, so what one size leaves over the next
    one makes up; ``start``, a hash of the source, decides where in a document rounding up begins, so the first ones are
    not always rounded the same way. The copies given never leave the sum of the rates by more than ``TRIM`` of the documents
    or one, however far words are then off.
    """
    groups = groups.sort_values(["size", "piece"], ascending=[False, True], kind="stable")
    size, n, rate = groups["size"].to_numpy(), groups["n"].to_numpy(), groups["rate"].to_numpy()
    start, most = float(groups["start"].iloc[0]), max(1.0, TRIM * float(n.sum()))
    low, high = np.floor(rate) * n, np.ceil(rate) * n
    more = np.zeros(len(n), np.int64)
    owed = over = 0.0  # words not given yet, copies given beyond the rates
    for i, want in enumerate(rate * n):
        fewest = max(low[i], np.ceil(want - over - most - 1e-9))
        given = min(high[i], np.floor(want - over + most + 1e-9), max(fewest, np.floor(want + owed / size[i] + start)))
        owed += (want - given) * size[i]
        over += given - want
        more[i] = given - low[i]
    return pd.DataFrame({"of": groups["source"], "long": size, "part": groups["piece"], "more": more})


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, all columns kept.

    Rows that share a doc_id are all taken as often as the one taken most. A copy is not marked as one.
    """
    taken = mix(docs, **settings).where("copies > 0").groupBy(F.col("doc_id").alias("mix key of")).agg(F.max("copies").alias("mix copies"))
    times = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("mix key of")))
    return times.withColumn("mix copy", F.explode(F.sequence(F.lit(1), F.col("mix copies").cast("int")))).select(*docs.columns)
