import random

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import minhash
from flowlens.llm.graph import components
from flowlens.llm.words import hashed, split_words
from tests.llm.conftest import by_id


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_components_of_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    rows = chain + [(1, i) for i in range(2, 60)] + [(7, 7), (9, 2), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 60)}}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    docs, base = [], [rng.choice(words) for _ in range(150)]
    for i in range(260):  # one family whose members differ from its first text by nothing to much, in chains
        text = list(base if i % 2 else [rng.choice(words) for _ in range(150)] if i % 10 == 0 else docs[-1][1].split())
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((1000 - i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k, percent).collect()}
    assert got == brute(docs, k, percent)


def test_odd_rows(odd_docs):
    got = by_id(minhash.near_duplicates(odd_docs, 3, 85))
    assert minhash.near_duplicates(odd_docs, 3, 85).count() == odd_docs.count()
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 10: 10, 11: 11, None: None}
    assert {i: r["n_shingles"] for i, r in got.items() if i in (1, 2, 3, 4, 10)} == {1: 0, 2: 0, 3: 0, 4: 1, 10: 1}
    assert got[5]["kept"] is False and got[None]["kept"] is True


def test_no_rows(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_estimate_is_close_to_the_similarity(spark):
    rng = np.random.default_rng(3)
    flip, factor = minhash._permutations()
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for shared in (0, 500, 900):
        a, b = pool[:1000], np.concatenate([pool[1000 - shared : 1000], pool[2000 : 3000 - shared]])
        best = np.stack([minhash.minima(x, flip, factor) for x in (a, b)])
        sig = minhash.packed(best)
        df = spark.createDataFrame([(sig[0].tolist(), sig[1].tolist())], "a array<long>, b array<long>")
        df = df.selectExpr("struct(a as sig) as x", "struct(b as sig) as y")
        truth = shared / (2000 - shared)
        assert abs(df.select(minhash.estimate("x", "y")).first()[0] - truth) < 0.08


def test_band_rows_keep_the_chance_of_a_miss():
    for t in (0.8, 0.85, 0.9):
        assert (1 - t ** minhash.band_rows(t)) ** minhash.BANDS <= 1e-5


def test_words_of_slices():
    """Batches are cut into slices, whose buffers begin before their first text."""
    texts = pa.array([f"Text {i} of É\nmany" if i % 7 else None for i in range(100)])
    for kind in (pa.string(), pa.large_string()):
        for at, size in ((0, 100), (3, 20), (50, 50), (99, 1), (100, 0)):
            for lower in (False, True):
                w = split_words(texts.cast(kind).slice(at, size), lower)
                w.words.validate(full=True)
                own = [[w.words[int(c)].as_py() for c in w.codes[a:b]] for a, b in zip(w.starts, w.starts[1:])]
                assert own == [[x.decode() for x in (t or "").encode().split()] if not lower else [x.decode() for x in (t or "").encode().lower().split()]
                               for t in texts.slice(at, size).to_pylist()]


def test_words_and_hashes():
    texts = ["  a b\x0bc\x1cd  \x85 q", None, "", "A É b\n", "x" * 70 + " y"]
    w = split_words(pa.array(texts))
    for i, t in enumerate(texts):
        own = [w.words[int(c)].as_py() for c in w.codes[w.starts[i] : w.starts[i + 1]]]
        assert own == [x.decode() for x in (t or "").encode().split()]
    many = pa.array([f"{i:0{1 + i % 23}d}" for i in range(20000)])
    assert len(set(hashed(many).tolist())) == len(set(many.to_pylist()))
    assert (hashed(many.slice(77, 9)) == hashed(many)[77:86]).all()


def test_estimate_and_bands_together_keep_the_stated_chance():
    """A pair at the threshold is lost by the bands or by the estimate with a chance of about 1e-5 in all."""
    import math

    for threshold in (0.8, 0.85):
        bands = (1 - threshold ** minhash.band_rows(threshold)) ** minhash.BANDS
        below = 0.5 * math.erfc(minhash._MARGIN / math.sqrt(2))
        assert bands + below <= 2 * minhash._MISSED


def test_pieces_are_cut_by_bytes():
    import pyarrow as pa

    from flowlens.llm.tokens import runs

    texts = pa.array(["x" * 400_000, None, "", "y" * 1_900_000, "z" * 5_000_000, "w"] + ["v" * 130_000] * 2000)
    cut = list(runs([texts], minhash.PIECE_BYTES))
    assert [a for a, _ in cut] == [sum(n for _, n in cut[:k]) for k in range(len(cut))] and sum(n for _, n in cut) == len(texts)
    for a, n in cut:
        size = sum(len(t or "") for t in texts.slice(a, n).to_pylist())
        assert size <= minhash.PIECE_BYTES or n == 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["a"] * 5000)], names=["id", "text"])
    assert [p.num_rows for p in minhash._slices(batch, 1)] == [minhash.PIECE_ROWS] * 5
