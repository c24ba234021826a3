"""Words of text batches as integer codes, split and numbered by Arrow in one go."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: space and the five ASCII controls after backspace.
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


@dataclass
class Words:
    """Row i has ``codes[starts[i]:starts[i + 1]]``; ``words[code]`` is the word as a string."""

    starts: np.ndarray
    codes: np.ndarray
    words: pa.Array

    def __len__(self) -> int:
        return len(self.starts) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def plain(texts: pa.Array) -> pa.Array:
    """The texts as large strings, null as empty, in buffers that begin with the first one.

    Slices share the buffers of the whole batch, and some string kernels (``ascii_lower`` of Arrow 23 among them) return
    wrong offsets for arrays whose offsets don't begin at 0.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or (texts.offset == 0 and ends[0] == 0):
        return texts
    data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(ends[0]), int(ends[-1] - ends[0]))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), data)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words between runs of ASCII white space; a null text has none."""
    texts = plain(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, starts = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    starts = starts - starts[0]
    encoded = flat.dictionary_encode()
    codes, words = np.asarray(encoded.indices), encoded.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # white space at either end of a text leaves an empty string there
        kept = codes != empty
        starts = np.concatenate([[0], np.cumsum(kept)])[starts]
        codes = codes[kept]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return Words(starts, codes, words)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h`` (the finaliser of a 64-bit multiplicative hash)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each word, eight bytes a step over the whole array."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer((words.buffers()[2] or pa.py_buffer(b"")), np.uint8)[ends[0] : ends[-1]]
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    at, size = ends[:-1] - ends[0], np.diff(ends)
    eight = np.lib.stride_tricks.as_strided(data.view(np.uint8)[:8].view(np.uint64), (len(data) - 7,), (1,))
    h, rows, left = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.arange(len(words)), size.copy()
    rows = rows[left > 0]
    while len(rows):
        n = np.minimum(left[rows], 8).astype(np.uint64)
        chunk = eight[at[rows]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * n))
        h[rows] = mixed(h[rows] * np.uint64(0x9E3779B97F4A7C15) + chunk)
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] > 0]
    return h


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` for each row; rows may be empty."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]
