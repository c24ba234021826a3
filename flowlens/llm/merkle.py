"""Merkle manifest of a dataset: a digest for each row, a tree for each group, a root over the groups, a proof for each row.

Leaves get their place from bitmaps instead of a sort of the rows. Tasks set a bit for each id in 64-bit words, the words
of a group are merged by OR, only words with a bit exist. Two directories of running counts, over the words of a box and
over the boxes of a group, answer a rank query: rows below the box, below the word, and below the bit. Leaves then go to
slot arrays keyed by the upper bits of their place, and each slot reduces ten levels of the tree at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import drop_written, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ids in a word, words in a box, and levels that a slot reduces, all as powers of two.
WORD, BOX, SLOT = 6, 10, 10


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def running(df: DataFrame, keys: list[str], weight: Column, to: str) -> DataFrame:
    """``to``: the sum of ``weight`` over all rows before this one in the order of ``keys``.

    Rows are range-partitioned and written once; a window runs inside each part, one number a part carries over.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *keys).withColumns({"in part": F.spark_partition_id(), "weight": weight}), "ranged")
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("in part").agg(F.sum("weight")).collect())
    offsets, total = [], 0
    for part, n in sums:
        offsets.append((part, total))
        total += n
    before = Window.partitionBy("in part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    table = spark.createDataFrame(offsets, "`in part` int, offset long")
    inside = ranged.withColumn(to, F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # one row for each part
    out = written(inside.join(F.broadcast(table), "in part").withColumn(to, F.col(to) + F.col("offset")).drop("in part", "weight", "offset"), "running")
    drop_written(ranged)
    return out


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; the keys come from the left."""
    renamed = right.select(*[F.col(k).alias(f"right {k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"right {k}"))
    return left.join(renamed, on, how).drop(*[f"right {k}" for k in keys])


def bitmaps(rows: DataFrame) -> DataFrame:
    """(grp, word, bits, n, below) of (grp, id): the words of each group's bitmap with their directory.

    ``n`` counts the rows of a word, copies of an id included, ``below`` the rows of the group before the word. Rows
    without id form the word null, before all others.
    """
    bit = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.expr("shiftleft(1L, cast(id & 63 AS int))"))
    words = rows.groupBy("grp", F.shiftright("id", WORD).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))
    words = written(words.withColumn("box", F.shiftright("word", BOX)), "words")
    boxes = running(words.groupBy("grp", "box").agg(F.sum("n").alias("rows")), ["grp", "box"], F.col("rows"), "base")
    firsts = boxes.groupBy("grp").agg(F.min("base").alias("first"))
    boxes = same(boxes, firsts, ["grp"]).select("grp", "box", (F.col("base") - F.col("first")).alias("base"))
    inside = Window.partitionBy("grp", "box").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)  # at most 1,024 words
    counted = words.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return same(counted, boxes, ["grp", "box"]).select("grp", "word", "bits", "n", (F.col("base") + F.col("inside")).alias("below"))


def places(rows: DataFrame) -> DataFrame:
    """``rows`` (id, grp, leaf and others) with ``at``: their place among the rows of the group by id, from 0 on.

    Rows without id come first, rows of the same id by leaf.
    """
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    words = written(bitmaps(rows.select("grp", "id")), "bitmaps")
    crowded = words.where("word IS NULL OR n > bit_count(bits)").select("grp", "word")
    ids = rows.select("grp", "id", F.shiftright("id", WORD).alias("word"))
    again = written(
        same(ids, crowded, ["grp", "word"], "left_semi").groupBy("grp", "id").agg(F.count("*").alias("copies")).where("copies > 1 OR id IS NULL"),
        "copies",
    )
    extra = again.where("id IS NOT NULL").groupBy("grp", F.shiftright("id", WORD).alias("word")).agg(  # at most 64 ids
        F.collect_list(F.struct("id", (F.col("copies") - 1).alias("more"))).alias("extra"))
    words_all = same(words.select("grp", "word", "bits", "below"), extra, ["grp", "word"], "left")
    lower = F.expr("bits & ~shiftleft(-1L, cast(id & 63 AS int))")
    more = F.expr("aggregate(filter(extra, e -> e.id < id), 0L, (s, e) -> s + e.more)")
    placed = written(
        same(rows.withColumn("word", F.shiftright("id", WORD)), words_all, ["grp", "word"])
        .withColumn("at", F.col("below") + F.coalesce(F.bit_count(lower), F.lit(0)) + F.coalesce(more, F.lit(0)))
        .withColumn("again", F.col("id").isNull() | F.coalesce(F.expr("exists(extra, e -> e.id = id)"), F.lit(False)))
        .drop("word", "bits", "below", "extra"), "placed"
    )
    tied = placed.where("again").select("row", "grp", "id", "leaf")
    out = placed.drop("again")
    if not tied.isEmpty():
        order = running(tied, ["grp", "id", "leaf", "row"], F.lit(1), "order")
        first = order.groupBy("grp", "id").agg(F.min("order").alias("first"))
        ties = same(order, first, ["grp", "id"]).select(F.col("row").alias("tied"), (F.col("order") - F.col("first")).alias("tie"))
        out = out.join(ties, F.col("row") == F.col("tied"), "left").withColumn("at", F.col("at") + F.coalesce("tie", F.lit(0))).drop("tied", "tie")
    out = written(out.drop("row"), "places")
    drop_written(rows, words, again, placed)
    return out


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def slot_tree(leaves: list[str], levels: int) -> tuple[str, list[str]]:
    """(node, paths) of a slot's leaves after so many levels.

    A path lists a leaf's sibling for each level: ``l`` or ``r`` for its side and its digest, or ``n`` without one.
    """
    paths, nodes = [""] * len(leaves), leaves
    for level in range(levels):
        for i in range(len(leaves)):
            own = i >> level
            other = own ^ 1
            paths[i] += ("l" if other < own else "r") + nodes[other] if other < len(nodes) else "n"
        nodes = [_hash("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def fold(leaf: str, path: str) -> tuple[str, str]:
    """(root, siblings): the root that follows from a leaf and its path, and the path's digests in a row."""
    at, seen = 0, []
    while at < len(path):
        side, other = path[at], path[at + 1 : at + 65]
        if side == "n":
            leaf, at = _hash(leaf), at + 1
            continue
        leaf = _hash(other + leaf if side == "l" else leaf + other)
        seen.append(other)
        at += 65
    return leaf, "".join(seen)


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):  # one slot
            one = batch.slice(row, 1)
            levels, ats = one.column(2)[0].as_py(), one.column(3)[0].as_py()
            array, mask = [""] * len(ats), (1 << SLOT) - 1
            for at, leaf in zip(ats, one.column(4)[0].as_py()):
                array[at & mask] = leaf
            node, paths = slot_tree(array, levels)
            n = len(array)
            yield pa.RecordBatch.from_arrays([
                one.column(0).take(pa.array([0] * n)), one.column(1).take(pa.array([0] * n)), pa.array(range(n), pa.int64()),
                pa.array(paths, pa.string()), pa.array([node] * n, pa.string()),
            ], names=["grp", "slot", "pos", "path", "node"])


@dataclass
class Forest:
    """``paths`` has (grp, at, path) of every leaf up to its group's root, ``roots`` (grp, root); both are written tables."""

    paths: DataFrame
    roots: DataFrame


def forest(leaves: DataFrame) -> Forest:
    """A binary tree for each group of (grp string, at long, leaf string); at counts from 0 on without gaps."""
    sizes = written(leaves.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    nodes, steps = leaves.select("grp", "at", "leaf"), []
    while True:
        # levels: ten, or fewer where fewer nodes are left
        left = sizes.select("grp", F.least(F.lit(SLOT), F.ceil(F.log2("n"))).cast("int").alias("levels"))
        slots = nodes.groupBy("grp", F.shiftright("at", SLOT).alias("slot")).agg(
            F.collect_list(F.struct("at", "leaf")).alias("held"))
        step = written(
            same(slots, left, ["grp"]).select("grp", "slot", "levels", F.col("held.at").alias("ats"), F.col("held.leaf").alias("leaves"))
            .mapInArrow(_reduced, "grp string, slot long, pos long, path string, node string"), "level"
        )
        steps.append(step)
        nodes = step.where("pos = 0").select("grp", F.col("slot").alias("at"), F.col("node").alias("leaf"))
        smaller = written(sizes.select("grp", F.ceil(F.col("n") / (1 << SLOT)).cast("long").alias("n")), "sizes")
        drop_written(sizes)
        sizes = smaller
        # a group that is down to one node stays as it is
        if sizes.where("n > 1").isEmpty():
            break
    roots = written(nodes.select("grp", F.col("leaf").alias("root")), "roots")
    paths = None
    for step in reversed(steps):
        own = step.select("grp", "slot", F.expr(f"slot * {1 << SLOT} + pos").alias("at"), "path")
        if paths is not None:
            upper = paths.select("grp", F.col("at").alias("slot"), F.col("path").alias("upper"))
            own = same(own, upper, ["grp", "slot"]).withColumn("path", F.concat("path", "upper"))
        paths = own.select("grp", "at", "path")
    paths = written(paths, "paths")
    drop_written(sizes, *steps)
    return Forest(paths, roots)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(1, 5)]
        proofs, roots = [], []
        for leaf, changed, low, top in zip(*columns):
            root, siblings = fold(leaf, low + top)
            proofs.append(_hash(siblings))
            roots.append(root if changed is None else fold(changed, low + top)[0])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(5), batch.column(6), pa.array(proofs, pa.string()), pa.array(roots, pa.string())],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, group: str = "lang", modulus: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs`` with the columns ``FIELDS``.

    A row's leaf is the digest of its fields; the leaves of a ``group`` by doc_id are hashed two by two up to the subroot,
    the subroots by group up to the root. ``proof_sha256`` is the digest of a leaf's siblings. ``folded_root`` follows from
    the leaf and its siblings; where ``modulus`` divides crc32 of the doc_id it follows from a leaf with n_chars + 1 instead,
    and ``verified`` says that it is the root.

    Defined cases: a null field counts as ``-``; a null group is the first one, a null doc_id comes first in its group and
    is not tampered with; rows of the same doc_id come by leaf; a null n_chars stays null when tampered with; a lone leaf is
    its group's subroot, a lone subroot the root, their proofs are the digest of nothing; an empty table gives no rows;
    other columns are not read.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 0, F.lit(False))
    fields = [F.col(c) for c in FIELDS]
    changed = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = places(docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col(group).cast("string").alias("grp"), digest(*fields).alias("leaf"),
        F.when(tampered, digest(*changed)).alias("changed"),
    ))
    trees = forest(rows)
    ordered = running(trees.roots, ["grp"], F.lit(1), "at")
    top = forest(ordered.select(F.lit("").alias("grp"), "at", F.col("root").alias("leaf")))
    upper = ordered.join(top.paths.select("at", F.col("path").alias("top")), "at").crossJoin(
        F.broadcast(top.roots.select(F.col("root").alias("whole")))  # one row
    )
    proven = same(
        same(rows, trees.paths, ["grp", "at"]), upper.select("grp", F.col("root").alias("subroot"), "top", "whole"), ["grp"]
    ).select("id", "leaf", "changed", "path", "top", "subroot", "whole").mapInArrow(
        _verified, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    out = written(proven.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    drop_written(rows, ordered, trees.paths, trees.roots, top.paths, top.roots)
    return out
