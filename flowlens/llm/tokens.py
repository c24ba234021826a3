"""Token ids of text batches: each distinct stretch of text goes through the tokenizer once per worker."""

from __future__ import annotations

import ctypes
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from flowlens.llm.words import hashed, plain, split_words

#: Text bytes that are encoded at a time, and cached stretches of text in a worker (about 40 bytes each).
PIECE_BYTES, CACHED = 2_000_000, 2_000_000
_C = ctypes.CDLL(None)
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!#$%&*,.:;?|"
#: White space other than one blank or line feed between two other characters.
_ODD_SPACE = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def slices(batch: pa.RecordBatch, text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` text bytes; a longer text is a run of its own."""
    for start, n in runs([batch.column(text)], most):
        yield batch.slice(start, n)


def give_back() -> None:
    """What is free in Arrow's pool and in C's heap goes back to the machine; else a reused worker keeps its largest piece."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):  # of glibc only
        _C.malloc_trim(0)


def runs(texts: list[pa.Array], most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows with about ``most`` bytes in all of the text arrays; a longer row is a run of its own.

    Between two runs Arrow gives back what the one before has used, and C's heap at the end, so that pieces don't add up in
    reused workers.
    """
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(t), 0), np.int64) for t in texts)
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if row > start and total + size > most:
            yield start, row - start
            pa.default_memory_pool().release_unused()
            start, total = row, 0
        total += size
    if start < len(texts[0]):
        yield start, len(texts[0]) - start
    give_back()


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``flat[starts[i]:starts[i] + sizes[i]]`` one after the other."""
    if not len(sizes):
        return flat[:0]
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class TextEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The tokenizer's own description decides how texts may be cut. ``spaced``: white space becomes one blank, is dropped
    before the merges and separates pieces, so words are encoded one by one; ASCII case is
    folded. ``bytes``: a blank belongs to the word after it, so a text is cut before blanks and
    line feeds; texts with other white space stay whole. Both cut letters
    from the marks after them. Any other tokenizer gets whole texts. Stretches are found in the
    cache by a 64-bit hash.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        steps = (about.get("normalizer") or {}).get("normalizers", [])
        before = about.get("pre_tokenizer") or {}
        parts = before.get("pretokenizers", [])
        self.kind = "whole"
        if [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"].get("Regex") == r"\s+":
            if parts and parts[0]["type"] == "Split" and parts[0]["invert"] and parts[0]["behavior"] == "Removed":
                self.kind = "spaced"
        elif about.get("normalizer") is None and before.get("type") == "ByteLevel":
            if before.get("use_regex") and not before.get("add_prefix_space"):
                self.kind = "bytes"
        added = about.get("added_tokens", [])
        self.added = [t["content"] for t in added]
        if any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in added):
            self.kind = "whole"
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = about["model"].get("end_of_word_suffix") or ""
        for token, i in self.tokenizer.get_vocab().items():  # byte-level tokenizers write a blank as this letter
            self.edge[i] = token.startswith("\u0120") if self.kind == "bytes" else bool(suffix) and token.endswith(suffix)
        if self.kind == "spaced" and not suffix:
            self.kind = "whole"
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self.keys = np.zeros(0, np.uint64)  # sorted hashes; ids of stretch i: flat[starts[i]:starts[i] + sizes[i]]
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(texts), 2000):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                sizes.append(len(ids[-1]))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(sizes, np.int64)

    def _encoded_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``. Words of letters only are one piece each, so many go at once and the ids tell them apart."""
        plain = np.asarray(pc.match_substring_regex(words, f"^{' ' if self.kind == 'bytes' else ''}[{_LETTER}]+$"))
        flat, sizes = self._encoded(words.filter(pa.array(~plain)).to_pylist())
        letters = words.filter(pa.array(plain)).to_pylist()
        joined, _ = self._encoded([(" " if self.kind == "spaced" else "").join(letters[i : i + 100]) for i in range(0, len(letters), 100)])
        edges = np.nonzero(self.edge[joined])[0]
        if len(edges) != len(letters):
            raise ValueError("the tokenizer's marks do not tell its words apart")
        bounds = np.concatenate([[0], edges + 1]) if self.kind == "spaced" else np.concatenate([edges, [len(joined)]])
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[~plain], lengths[~plain] = np.cumsum(sizes) - sizes, sizes
        starts[plain], lengths[plain] = len(flat) + bounds[:-1], np.diff(bounds)
        return ragged(np.concatenate([flat, joined]), starts, lengths), lengths

    def _looked_up(self, stretches: pa.Array) -> np.ndarray:
        """The cache's index for each stretch; those it lacks are encoded first."""
        h = hashed(stretches)
        for _ in range(2):
            at = np.searchsorted(self.keys, h)
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == h if len(self.keys) else np.zeros(len(h), bool)
            if known.all():
                break
            new, first = np.unique(h[~known], return_index=True)
            if len(self.keys) + len(new) > CACHED:
                self.forget()
                new, first = np.unique(h, return_index=True)
                texts = stretches
            else:
                texts = stretches.filter(pa.array(~known))
            flat, sizes = self._encoded_words(texts.take(pa.array(first)))
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.keys, self.starts, self.sizes = keys[order], starts[order], np.concatenate([self.sizes, sizes])[order]
            self.flat = np.concatenate([self.flat, flat])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): row i has ``ids[starts[i]:starts[i + 1]]``. A null text counts as an empty one."""
        rows, first, size, flat = self._stretches(plain(texts))
        return ragged(flat, first, size), np.concatenate([[0], np.cumsum(size)])[rows]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        rows, _, size, _ = self._stretches(plain(texts))
        return np.diff(np.concatenate([[0], np.cumsum(size)])[rows])

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row i is the stretches rows[i]:rows[i + 1]; the ids of stretch k are flat[first[k]:first[k] + size[k]]."""
        if self.kind == "spaced":
            rows, at = self._word_stretches(texts)
            return rows, self.starts[at], self.sizes[at], self.flat
        whole = np.ones(len(texts), bool)
        if self.kind == "bytes":
            whole = np.asarray(pc.match_substring_regex(texts, _ODD_SPACE))
        ids, sizes = self._encoded(texts.filter(pa.array(whole)).to_pylist())
        if whole.all():
            return np.arange(len(texts) + 1), np.cumsum(sizes) - sizes, sizes, ids
        rows, at = self._blank_stretches(texts if not whole.any() else pc.if_else(pa.array(whole), "", texts))
        first, size = self.starts[at], self.sizes[at]
        if whole.any():  # such a row has empty stretches so far
            here = rows[:-1][whole]
            first[here], size[here] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        return rows, first, size, np.concatenate([self.flat, ids]) if len(ids) else self.flat

    def _word_stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = split_words(texts)
        folded = pc.ascii_lower(words.words)
        special = pa.array(np.zeros(len(folded), bool))
        for token in self.added:  # these are looked for before case is folded
            special = pc.or_(special, pc.match_substring(folded, token.lower()))
        folded = pc.if_else(special, words.words, folded)
        return self._cut(words.starts, words.codes, pc.if_else(special, words.words, folded), special)

    def _cut(self, rows: np.ndarray, codes: np.ndarray, words: pa.Array, special: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cache indexes after a cut between a word's last letter and the marks that follow it."""
        core = pc.utf8_rtrim(words, _MARKS)
        cut = pc.and_not(pc.match_substring_regex(core, f"[{_LETTER}]$"), special)
        core = pc.if_else(cut, core, words)
        at = self._looked_up(pa.concat_arrays([core, self._tails(words, core)]))
        code = np.empty(2 * len(codes), np.int64)
        code[0::2], code[1::2] = codes, codes + len(core)
        return 2 * rows, at[code]

    def _blank_stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        rows = np.asarray(lists.offsets, np.int64)
        rows = rows - rows[0]
        encoded = lists.flatten().dictionary_encode()
        words, codes = encoded.dictionary, np.asarray(encoded.indices).astype(np.int64)
        blank = pa.scalar(" ", pa.large_string())
        spaced = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(blank, words, pa.scalar("", pa.large_string())))
        first, again = np.unique(codes[rows[:-1]], return_inverse=True)  # a text's first word has no blank before it
        codes[rows[:-1]] = len(words) + again
        words = pa.concat_arrays([spaced, words.take(pa.array(first))])
        special = pa.array(np.zeros(len(words), bool))
        for token in self.added:
            special = pc.or_(special, pc.match_substring(words, token))
        return self._cut(rows, codes, words, special)

    @staticmethod
    def _tails(words: pa.Array, core: pa.Array) -> pa.Array:
        """What is left of each word after its core."""
        w, c = words.cast(pa.large_binary()), core.cast(pa.large_binary())
        ends = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1]
        left = ends[:-1] + np.asarray(pc.binary_length(c), np.int64)
        data = np.frombuffer(w.buffers()[2] or pa.py_buffer(b""), np.uint8)
        size = ends[1:] - left
        offsets = np.concatenate([[0], np.cumsum(size)])
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(w), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ragged(data, left, size))]
        ).cast(pa.large_string())


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for the tokenizer file, which every machine has at this path."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def forget(path: str) -> None:
    """Drop what the worker's encoder of that file keeps, if there is one: the worker goes on to other steps."""
    if path in _ENCODERS:
        _ENCODERS[path].forget()
    give_back()
