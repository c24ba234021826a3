"""Near-duplicate documents by b-bit MinHash.

Every document gets ``HASHES`` minima of its shingle hashes. Runs of full minima are the band keys that propose
candidates; of all minima only the low ``BITS`` bits are kept, packed into longs. The share of equal cells, corrected
for chance collisions, estimates the similarity, drops hopeless candidates, and the full shingle sets decide the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.graph import components
from flowlens.llm.tokens import runs
from flowlens.llm.words import hashed, mixed, split_words
from flowlens.session import drop_written, written

HASHES, BITS, BANDS = 512, 4, 32
_CELLS = 64 // BITS
_LONGS = HASHES // _CELLS
#: A link at the threshold is missed by no more than this chance.
_MISSED = 1e-5
#: Standard deviations below the threshold at which an estimate counts as hopeless.
_MARGIN = 4.5
_ROTATE = np.uint64(0x9E3779B97F4A7C15)
#: Text bytes and rows that are worked on at a time.
PIECE_BYTES, PIECE_ROWS = 2_000_000, 1000


def band_rows(threshold: float, bands: int = BANDS) -> int:
    """The longest band for which a pair at the threshold shares one of the bands but for a chance of ``_MISSED``."""
    rows = 1
    while rows < HASHES // bands and (1 - threshold ** (rows + 1)) ** bands <= _MISSED:
        rows += 1
    return rows


def estimate_floor(threshold: float) -> float:
    """Estimates below this value rule a pair out."""
    chance = 2.0**-BITS
    match = chance + (1 - chance) * threshold
    return threshold - _MARGIN * math.sqrt(match * (1 - match) / HASHES) / (1 - chance)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the sorted distinct shingle hashes of row i are ``hashes[starts[i]:starts[i + 1]]``.

    Words are lower-cased in ASCII. A text with fewer than ``size`` words has its whole word sequence as the only
    shingle; one without words, or null, has none.
    """
    words = split_words(texts, lower=True)
    h = hashed(words.words)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    counts = words.sizes()
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(counts)), made)
    first = words.starts[row] + np.arange(len(row)) - starts[row]
    used = np.minimum(counts, size)[row]
    value = np.zeros(len(row), np.uint64)
    for k in range(size):
        inside = used > k
        value[inside] = mixed(value[inside] * _ROTATE + h[first[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, HASHES, np.uint32), rng.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)


def minima(hashes: np.ndarray, flip: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over the upper halves of the hashes, in blocks that stay in the cache."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 128):
        np.minimum(best, ((x[at : at + 128, None] ^ flip) * factor).min(axis=0), out=best)
    return best


def packed(best: np.ndarray) -> np.ndarray:
    """The low bits of the minima of each row, ``_CELLS`` to a long."""
    cells = (best & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(best), _LONGS, _CELLS)
    return np.bitwise_or.reduce(cells << (np.uint64(BITS) * np.arange(_CELLS, dtype=np.uint64)), axis=2).view(np.int64)


def signatures(docs: DataFrame, shingle: int, rows: int) -> DataFrame:
    """(id, n, d1, d2, keys, sig) for (id, text): set size, 128-bit digest of the set, band keys, packed low bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, factor = _permutations()
        band = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for part in _slices(batch, 1):
                sets, starts = shingle_sets(part.column(1), shingle)
                n = np.diff(starts)
                best = np.zeros((len(n), HASHES), np.uint32)
                digests = np.zeros((len(n), 2), np.uint64)
                for i in np.nonzero(n)[0]:
                    own = sets[starts[i] : starts[i + 1]]
                    best[i] = minima(own, flip, factor)
                    digests[i] = mixed(own).sum(), mixed(own * _ROTATE + np.uint64(1)).sum()
                keys = np.broadcast_to(band, (len(n), BANDS)).copy()
                for k in range(rows):
                    keys = mixed(keys * _ROTATE + best[:, k * BANDS : (k + 1) * BANDS])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n, pa.int64()), pa.array(digests[:, 0].view(np.int64)),
                    pa.array(digests[:, 1].view(np.int64)), _lists(keys.view(np.int64)), _lists(packed(best)),
                ], names=["id", "n", "d1", "d2", "keys", "sig"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, keys array<long>, sig array<long>")


def _slices(batch: pa.RecordBatch, *texts: int) -> Iterator[pa.RecordBatch]:
    """Pieces with few text bytes and few rows, so that the arrays made from them stay small."""
    for start, n in runs([batch.column(i) for i in texts], PIECE_BYTES):
        for at in range(start, start + n, PIECE_ROWS):
            yield batch.slice(at, min(PIECE_ROWS, start + n - at))


def _lists(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: share of equal cells, less the share that is equal by chance."""
    low = F.lit(sum(1 << (BITS * i) for i in range(_CELLS)))
    differ = F.lit(0)
    for i in range(_LONGS):
        x = F.col(f"{a}.sig")[i].bitwiseXOR(F.col(f"{b}.sig")[i])
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        differ = differ + F.bit_count(x.bitwiseAND(low))
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def similar_size(a: str, b: str, percent: int) -> Column:
    return (100 * F.col(f"{a}.n") >= percent * F.col(f"{b}.n")) & (100 * F.col(f"{b}.n") >= percent * F.col(f"{a}.n"))


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of which the full shingle sets have 100 * intersection >= percent * union."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = written(docs.join(needed, "id", "left_semi").select("id", "text"), "texts")
    both = (
        pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2, 3):
                sides = []
                for ids, text in ((0, 2), (1, 3)):  # a document of many pairs is split into words once
                    _, first, at = np.unique(np.asarray(part.column(ids)), return_index=True, return_inverse=True)
                    sets, starts = shingle_sets(part.column(text).take(pa.array(first)), shingle)
                    sides.append((sets, starts, at))
                (x, xs, xi), (y, ys, yi) = sides
                linked = np.zeros(part.num_rows, bool)
                for row in range(part.num_rows):
                    p, q = x[xs[xi[row]] : xs[xi[row] + 1]], y[ys[yi[row]] : ys[yi[row] + 1]]
                    at = np.searchsorted(q, p)
                    shared = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                    linked[row] = shared and 100 * shared >= percent * (len(p) + len(q) - shared)
                yield part.select([0, 1]).filter(pa.array(linked))

    found = written(both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long"), "links")
    drop_written(texts)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``, which needs a long doc_id and a text.

    Two documents are linked if ``percent`` of the union of their distinct shingles of ``shingle`` words is shared;
    component_id is the smallest doc_id reachable over links, kept marks the document that stands for its component.

    * Copies (equal sets) become one node first, so a group of copies costs one row per document.
    * Each band bucket proposes its members to its smallest member only. Where a bucket still holds several components
      afterwards, the members outside its largest one are tried against all members of other components; those
      buckets are the few that hold documents just below the threshold. So no link between components is lost, and
      no bucket emits all its pairs.
    * Hot buckets: grouping is a minimum, combined before the shuffle; joins on them are split by AQE.

    Defined cases: null or wordless text has no shingles and is linked with nothing (component_id = doc_id). Rows with
    a null doc_id are linked by equal sets only; their component_id is that of the equal documents, or null, and such a
    row is kept only if it is null. Rows with the same doc_id are one document. An empty table gives no rows.
    Columns beyond doc_id and text are not read.
    """
    threshold = percent / 100
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sigs = written(signatures(base, shingle, band_rows(threshold)), "signatures")
    full = sigs.where("n > 0")
    reps = written(
        full.where("id IS NOT NULL").groupBy("d1", "d2")
        .agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "sets"
    )
    rows = reps.select("node", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("members")).where("members > 1")
    members = written(rows.join(buckets, "key").select("key", "node", "center"), "members")
    wide = reps.select("node", "n", "sig", "keys")

    stars = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(
        stars.join(wide.alias("x"), F.col("a") == F.col("x.node")).join(wide.alias("y"), F.col("b") == F.col("y.node"))
        .where(similar_size("x", "y", percent) & (estimate("x", "y") >= estimate_floor(threshold))).select("a", "b"), "pairs"
    )
    links = confirmed(tried, base, shingle, percent)
    first = components(links)

    labelled = members.join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed_keys = (
        sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts"))
        .where("parts > 1").select("key", "largest")
    )
    open_rows = written(labelled.join(mixed_keys, "key").join(wide, "node").select(
        "key", "node", "component", (F.col("component") != F.col("largest")).alias("outside"), "n", "sig", "keys"), "open")
    x, y = open_rows.where("outside").alias("x"), open_rows.alias("y")
    shared = F.lit(None).cast("long")
    for i in reversed(range(BANDS)):  # the first key that both have, so that a pair comes from one bucket only
        shared = F.when(F.col("x.keys")[i] == F.col("y.keys")[i], F.col("x.keys")[i]).otherwise(shared)
    rest = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
               & (~F.col("y.outside") | (F.col("x.node") < F.col("y.node"))) & similar_size("x", "y", percent)
               & (estimate("x", "y") >= estimate_floor(threshold)) & (shared == F.col("x.key")))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct().join(tried, ["a", "b"], "left_anti")
    )
    rest = written(rest, "pairs")
    more = confirmed(rest, base, shingle, percent)
    known = first.select(F.col("node"), F.col("component"))
    second = components(
        more.join(known.alias("p"), F.col("a") == F.col("p.node"), "left").select(end_of("a", "p"), "b")
        .join(known.alias("q"), F.col("b") == F.col("q.node"), "left").select("a", end_of("b", "q"))
    )
    final = (
        reps.select("d1", "d2", "node").join(known, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("part"))
        .join(second.select(F.col("node").alias("part"), F.col("component").alias("whole")), "part", "left")
        .select("d1", "d2", F.coalesce("whole", "part").alias("component_id"))
    )
    out = written(
        sigs.select("id", "n", "d1", "d2").join(final, ["d1", "d2"], "left").select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-duplicates"
    )
    drop_written(sigs, reps, members, tried, links, open_rows, rest, more, first, second)
    return out


def end_of(side: str, known: str) -> Column:
    return F.coalesce(F.col(f"{known}.component"), F.col(side)).alias(side)
