"""Substring duplicates by suffix automata.

Reference shards are stretches of words around anchors that occur more than once. An anchor is the smallest hash among the
runs of ``RUN`` words of a window, so equal windows have equal anchors, and everything that a window can match lies in the
shard of its anchor: an automaton goes to the tasks that stream its shard, not to all. Each automaton holds the distinct
stretches of a shard with their number of copies; the stretches are streamed through it, and the matching statistic of a
word is the length of the longest run of words up to it that occurs elsewhere too. Runs of the threshold's length or more
are what goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.merkle import same
from flowlens.llm.tokens import slices
from flowlens.llm.words import hashed, mixed, plain, split_words
from flowlens.session import drop_written, written

#: Words of a run whose hash may become an anchor.
RUN = 8
#: Words in an automaton, and distinct stretches around one anchor above which its windows are dealt one by one.
SHARD_WORDS, CROWD = 150_000, 1000
PIECE_BYTES = 4_000_000
_ROTATE = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` of the word hashes."""
    n = max(len(h) - size + 1, 0)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = mixed(value * _ROTATE + h[k : k + n])
    return value


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """For each stretch of ``span`` values the place of its smallest one, the first of equal ones."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, width = np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        width += step
    return at[:n]


def anchors(h: np.ndarray, starts: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first windows, anchor hashes) of each row of words: windows from one first to the next share an anchor."""
    run = min(RUN, window)
    runs = run_hashes(h, run)
    places = smallest(runs, window - run + 1)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a < window:
            yield np.zeros(0, np.int32), np.zeros(0, np.int64)
            continue
        own = places[a : b - window + 1]
        first = np.concatenate([[0], np.nonzero(own[1:] != own[:-1])[0] + 1])
        yield first.astype(np.int32), runs[own[first]].view(np.int64)


def _words_of(text: str | None) -> list[bytes]:
    """bytes.split cuts at the same six bytes as the pattern of words."""
    return (text or "").encode().split()


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _digests(hexes: list[str]) -> tuple[list[int], list[int]]:
    return [int.from_bytes(bytes.fromhex(x[:16]), "big", signed=True) for x in hexes], [int.from_bytes(bytes.fromhex(x[16:32]), "big", signed=True) for x in hexes]


def marked(docs: DataFrame, window: int) -> DataFrame:
    """(id, raw, n_words, whole, d1, d2, firsts, hashes) of (id, text, raw): digest of the words, and the anchors of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in batches:
            for part in slices(batch, 1, PIECE_BYTES):
                texts = plain(part.column(1))
                words = split_words(texts)
                h = hashed(words.words)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
                found = list(anchors(h, words.starts, window))
                whole = [hashlib.sha256(b" ".join(_words_of(t))).hexdigest() for t in texts.to_pylist()]
                d1, d2 = _digests(whole)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array(words.sizes(), pa.int64()), pa.array(whole, pa.string()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    _lists([f for f, _ in found], pa.int32()), _lists([a for _, a in found], pa.int64()),
                ], names=["id", "raw", "n_words", "whole", "d1", "d2", "firsts", "hashes"])
                del words, h, found, whole
            pool.release_unused()

    return docs.mapInArrow(run, "id long, raw long, n_words long, whole string, d1 long, d2 long, firsts array<int>, hashes array<long>")


class SuffixAutomaton:
    """Of a list of word-code stretches, each with a number of copies. ``twice[v]``: the longest suffix of state v's words
    that occurs at least twice."""

    def __init__(self, stretches: list[list[int]], copies: list[int]):
        step, link, length, count = [{}], [-1], [0], [0]
        last = 0
        for k, stretch in enumerate(stretches):
            for code in (*stretch, -1 - k):  # a code of its own ends each stretch
                now = len(step)
                step.append({})
                length.append(length[last] + 1)
                count.append(copies[k])
                link.append(0)
                p = last
                while p >= 0 and code not in step[p]:
                    step[p][code] = now
                    p = link[p]
                if p >= 0:
                    q = step[p][code]
                    if length[p] + 1 == length[q]:
                        link[now] = q
                    else:
                        clone = len(step)
                        step.append(step[q].copy())
                        length.append(length[p] + 1)
                        count.append(0)
                        link.append(link[q])
                        link[q] = link[now] = clone
                        while p >= 0 and step[p].get(code) == q:
                            step[p][code] = clone
                            p = link[p]
                last = now
        order = np.argsort(np.array(length), kind="stable").tolist()
        for v in reversed(order[1:]):
            count[link[v]] += count[v]
        twice = [0] * len(step)
        for v in order[1:]:
            twice[v] = length[v] if count[v] >= 2 else twice[link[v]]
        self.step, self.link, self.length, self.twice = step, link, length, twice

    def statistics(self, stretch: list[int]) -> list[int]:
        """For each word the length of the longest run up to it that occurs at least twice in what the automaton holds."""
        out, v, n = [], 0, 0
        for code in stretch:
            while v and code not in self.step[v]:
                v = self.link[v]
                n = self.length[v]
            if code in self.step[v]:
                v, n = self.step[v][code], n + 1
            out.append(min(n, self.twice[v]))
        return out


def _codes(texts: list[str]) -> list[list[int]]:
    known: dict[str, int] = {}
    return [[known.setdefault(w, len(known)) for w in t.split(" ")] for t in texts]


def judged(stretches: DataFrame, window: int) -> DataFrame:
    """(d1, d2, mask) of (shard, d1, d2, text, copies): bit j says that the window at word j of the stretch occurs elsewhere."""
    def run(table: pa.Table) -> pa.Table:
        codes = _codes(table.column("text").to_pylist())
        automaton = SuffixAutomaton(codes, table.column("copies").to_pylist())
        masks = []
        for stretch in codes:
            mask = 0
            for end, n in enumerate(automaton.statistics(stretch)):
                if n >= window:
                    mask |= 1 << (end - window + 1)
            masks.append(mask)
        return pa.table([table.column("d1"), table.column("d2"), pa.array(masks, pa.int64())], names=["d1", "d2", "mask"])

    return stretches.groupBy("shard").applyInArrow(run, "d1 long, d2 long, mask long")


def _stretches(window: int):
    """Rows (cid, copies, text, places) to (cid, first, h, d1, d2, text, copies): the words that an anchor's windows cover."""
    names = ["cid", "first", "h", "d1", "d2", "text", "copies"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for row in range(batch.num_rows):
                cid, copies, text, places = (c[row].as_py() for c in batch.columns)
                words = _words_of(text)
                for p in places:
                    stretch = b" ".join(words[p["first"] : p["last"] + window])
                    digest = hashlib.sha256(stretch + p["h"].to_bytes(8, "big", signed=True)).digest()
                    rows.append((cid, p["first"], p["h"], int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True), stretch.decode(), copies))
                    held += len(stretch) + 100
                    if held > PIECE_BYTES:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    return run, "cid long, first int, h long, d1 long, d2 long, text string, copies long"


def _windows(window: int):
    """Stretches (d1, d2, text, copies) to their single windows (d1, d2, place, w1, w2, text, copies)."""
    names = ["d1", "d2", "place", "w1", "w2", "text", "copies"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, PIECE_BYTES // 32):
                rows = []
                for d1, d2, text, copies in zip(*(c.to_pylist() for c in part.columns)):
                    words = text.split(" ")
                    for place in range(len(words) - window + 1):
                        own = " ".join(words[place : place + window])
                        digest = hashlib.sha256(own.encode()).digest()
                        rows.append((d1, d2, place, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True), own, copies))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run, "d1 long, d2 long, place int, w1 long, w2 long, text string, copies long"


def _spans(window: int):
    """Rows (cid, n_words, text, marks) to (cid, n_removed, kept, removed)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, PIECE_BYTES):
                counts, kept, spans = [], [], []
                for row in range(part.num_rows):
                    words = _words_of(part.column(1)[row].as_py())
                    gone = np.zeros(len(words) + 1, np.int64)
                    for m in part.column(2)[row].as_py():
                        mask, at = m["mask"], m["first"]
                        while mask:
                            if mask & 1:
                                gone[at] += 1
                                gone[at + window] -= 1
                            mask, at = mask >> 1, at + 1
                    gone = np.cumsum(gone) > 0
                    edges = np.nonzero(np.diff(gone, prepend=False))[0].tolist()
                    counts.append(int(gone.sum()))
                    spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                    kept.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(span))],
                    names=["cid", "found", "left", "spans"])

    return run, "cid long, found long, left string, spans array<struct<start: long, end: long>>"


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) for every row of ``docs`` (doc_id, text).

    Every word goes that lies in a run of ``window`` words which also starts anywhere else, in the same text or in another;
    ``removed`` has the maximal spans of such words as word offsets, ``kept_sha256`` is the digest of what is left, joined by one
    blank. ``window`` is at most ``RUN`` + 62.

    * Texts of the same words count as one with copies; stretches of the same words around the same anchor too.
    * Anchors with more than ``CROWD`` distinct stretches deal out single windows by their own digest, so that no anchor
      fills an automaton. Automata hold about ``SHARD_WORDS`` words; their number follows the data.

    Defined cases: null and wordless text has no words; a text shorter than the window keeps all; repeated rows and copies
    of a text lose all words if it is long enough; a null doc_id is kept as it is; an empty table gives no rows; other
    columns are not read.
    """
    if not 0 < window <= RUN + 62:
        raise ValueError(f"window must be from 1 to {RUN + 62}")
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("raw", F.xxhash64("text"))
    rows = written(marked(base, window), "marked")
    contents = written(
        rows.where(F.col("n_words") >= window).groupBy("d1", "d2").agg(
            F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNotNull().alias("has"), "id", "raw")).alias("of"),
            F.first("n_words").alias("n_words"), F.first("firsts").alias("firsts"), F.first("hashes").alias("hashes"),
        ).withColumn("cid", F.monotonically_increasing_id()), "contents"
    )
    each = F.expr(f"""transform(hashes, (h, k) -> struct(h, firsts[k] AS first,
        coalesce(try_element_at(firsts, k + 2), cast(n_words AS int) - {window - 1}) - 1 AS last))""")
    spread = contents.select("cid", "copies", F.inline(each))
    often = spread.groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h")
    lists = spread.join(often, "h").groupBy("cid").agg(F.collect_list(F.struct("first", "last", "h")).alias("places"))
    lists = lists.join(contents.select("cid", "copies", F.col("of.id").alias("id"), F.col("of.raw").alias("raw")), "cid")
    # rows that agree in id and text all join; their words occur more than once in any case
    texts = written(same(base, lists, ["id", "raw"]).select("cid", "copies", "text", "places"), "texts")
    cut, schema = _stretches(window)
    places = written(texts.mapInArrow(cut, schema), "stretches")
    distinct = written(places.groupBy("h", "d1", "d2").agg(F.first("text").alias("text"), F.sum("copies").alias("copies")), "distinct")
    crowds = written(distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("h"), "crowds")
    few = distinct.join(crowds, "h", "left_anti")
    shards = max(1, -(-(few.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0) // SHARD_WORDS))
    masks = judged(few.select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "d1", "d2", "text", "copies"), window)

    one, one_schema = _windows(window)
    single = distinct.join(crowds, "h", "left_semi").select("d1", "d2", "text", "copies")
    single = written(single.mapInArrow(one, one_schema), "windows")
    own = written(single.groupBy("w1", "w2").agg(F.first("text").alias("text"), F.sum("copies").alias("copies")), "windows")
    cells = max(1, -(-own.count() * window // SHARD_WORDS))
    alone = judged(own.select(F.pmod("w1", F.lit(cells)).alias("shard"), F.col("w1").alias("d1"), F.col("w2").alias("d2"), "text", "copies"), window)
    again = alone.where("mask <> 0").select(F.col("d1").alias("w1"), F.col("d2").alias("w2"))
    crowded = single.select("d1", "d2", "place", "w1", "w2").join(again, ["w1", "w2"]).groupBy("d1", "d2").agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    masks = written(masks.where("mask <> 0").unionByName(crowded), "masks")

    marks = places.select("cid", "first", "d1", "d2").join(masks, ["d1", "d2"]).groupBy("cid").agg(
        F.collect_list(F.struct("first", "mask")).alias("marks"))
    fold, fold_schema = _spans(window)
    found = texts.where("copies = 1").select("cid", "text").join(marks, "cid").select("cid", "text", "marks").mapInArrow(fold, fold_schema)
    whole = F.col("copies") > 1
    out = written(
        rows.select("id", "n_words", "whole", "d1", "d2").join(contents.select("d1", "d2", "copies", "cid"), ["d1", "d2"], "left")
        .join(found, "cid", "left").select(
            F.col("id").alias("doc_id"), "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("found", F.lit(0))).alias("n_removed"),
            F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("left", "whole")).alias("kept_sha256"),
            F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))))
            .otherwise(F.coalesce("spans", F.expr("array()"))).alias("removed"),
        ), "repeats"
    )
    drop_written(rows, contents, texts, places, distinct, crowds, single, own, masks)
    return out
