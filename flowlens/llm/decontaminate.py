"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows scans every text once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.tokens import slices

#: Words are runs of digits, letters and everything beyond ASCII; A-Z count as a-z, all other ASCII separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW = 13
#: Text bytes of benchmark items in one automaton (about 400 times as much memory); a larger benchmark takes several.
BLOCK_BYTES = 500_000
#: Documents, or with several automata, which are built anew for each piece, text bytes, that are scanned at a time.
_PIECE, PIECE_BYTES = 256, 32_000_000


def normalised(text: str) -> bytes:
    """The words of a text, each with one space before it, and one at the end; the empty text if there are none."""
    words = text.encode().translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(text: str, size: int = WINDOW) -> set[bytes]:
    """All runs of ``size`` words, or the whole word sequence of a shorter text."""
    words = text.encode().translate(_FOLD).split()
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    return {b" " + b" ".join(run) + b" " for run in runs}


def automaton(items: list[tuple[str, str]], size: int = WINDOW) -> ahocorasick.Automaton:
    """Of (item, text) pairs; the value of a window is its length and the items that hold it."""
    held: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(text, size):
            held.setdefault(window, set()).add(item)
    out = ahocorasick.Automaton()
    for window, of in held.items():  # bytes as Latin-1 characters: one character a byte
        out.add_word(window.decode("latin-1"), (len(window), tuple(of)))
    if len(out):
        out.make_automaton()
    return out


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Byte ranges [from, to) of ``text``, which is normalised, inside any window, and the items of those windows."""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    if len(machine) and text:
        for end, (length, of) in machine.iter(text.decode("latin-1")):
            start = end - length + 1
            items.update(of)
            while spans and spans[-1][1] > start + 1:  # windows that overlap by more than the space between words
                start = min(start, spans.pop()[0])
            spans.append((start, end + 1))
    return spans, items


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character in the original text of each word."""
    folded = np.frombuffer(text.encode().translate(_FOLD), np.uint8)
    inside = np.concatenate([[False], folded != 32, [False]])
    turns = np.nonzero(inside[1:] != inside[:-1])[0]
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # bytes to characters
    return chars[turns[::2]], chars[turns[1::2]]


def items_in_blocks(benchmark: DataFrame) -> list:
    """Broadcast lists of (item, text), each of ``BLOCK_BYTES`` at most (or one larger item)."""
    texts = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL").distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES))  # half full on average, as the dealing is by hash
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    context = benchmark.sparkSession.sparkContext
    return [
        context.broadcast([(r.item, r.text) for r in dealt.where(F.col("block") == b).select("item", "text").collect()])
        for b in range(blocks)
    ]


_LATEST: list = [None, 0, None]


def _machine(block, size: int) -> ahocorasick.Automaton:
    """The automaton of a block; a worker keeps the latest only, so its memory doesn't grow with the benchmark."""
    if _LATEST[0] is not block or _LATEST[1] != size:
        _LATEST[:] = block, size, automaton(block.value, size)
    return _LATEST[2]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every row of ``docs``.

    A window is ``size`` consecutive words of an item of ``benchmark`` (item_id, text), or all words of a shorter one. A
    word of a document inside any occurrence of a window is hit. contaminated: n_hit > 0 and share * n_hit >= n_words.
    spans holds the stretches of hit words as character offsets (start, end) in the original text.

    The benchmark is broadcast in blocks of bounded size, one automaton each; a text is normalised once and scanned once
    for each block, and there is one block unless the benchmark is larger than half of ``BLOCK_BYTES``. With several, all
    texts of a batch meet one automaton before the next one is built. No shuffle.

    Defined cases: a null or wordless text has no words and is clean; a null or wordless item has no windows; a null
    item_id counts as the empty string; items with the same text are all counted, repeated rows once; an empty benchmark
    leaves every document clean. Rows of ``docs`` keep their number; other columns are not read.
    """
    blocks = items_in_blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, len(blocks)):
                yield _scanned(piece, blocks, size, share)

    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<struct<start: long, end: long>>"
    )


def _pieces(batch: pa.RecordBatch, blocks: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of (doc_id, text) that are scanned at a time."""
    if blocks > 1:
        yield from slices(batch, 1, PIECE_BYTES)
    else:
        yield from (batch.slice(at, _PIECE) for at in range(0, batch.num_rows, _PIECE))


def _scanned(part: pa.RecordBatch, blocks: list, size: int, share: int) -> pa.RecordBatch:
    texts = [t or "" for t in part.column(1).to_pylist()]
    folded = [normalised(t) for t in texts]
    found = [([], set()) for _ in texts]
    for block in blocks:
        machine = _machine(block, size)
        for row, text in enumerate(folded):
            spans, items = scan(text, machine)
            found[row][0].extend(spans)
            found[row][1].update(items)
    out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
    for text, flat, (spans, items) in zip(texts, folded, found):
        n = max(0, flat.count(b" ") - 1)
        hit, stretches = 0, []
        if spans:
            word = np.cumsum(np.frombuffer(flat, np.uint8) == 32)  # words begun up to each byte
            inside = np.zeros(n + 1, np.int64)
            for start, end in spans:
                inside[word[start] - 1] += 1
                inside[word[end - 1] - 1] -= 1
            covered = np.cumsum(inside)[:n] > 0
            hit = int(covered.sum())
            edges = np.nonzero(np.diff(np.concatenate([[False], covered, [False]])))[0]
            first, last = word_offsets(text)
            stretches = [{"start": int(first[a]), "end": int(last[b - 1])} for a, b in zip(edges[::2], edges[1::2])]
        out["n_words"].append(n)
        out["n_hit"].append(hit)
        out["n_items"].append(len(items))
        out["items_sha256"].append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
        out["contaminated"].append(hit > 0 and share * hit >= n)
        out["spans"].append(stretches)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays(
        [part.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["doc_id", *out]
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept; cases as in ``contamination``."""
    blocks = items_in_blocks(benchmark)

    @F.pandas_udf("boolean")
    def dirty(texts):
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts)), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
        out = [c for part in _pieces(batch, len(blocks)) for c in _scanned(part, blocks, size, share).column("contaminated").to_pylist()]
        return pd.Series(out, dtype=bool)

    return docs.where(~dirty(F.col("text").cast("string")))
