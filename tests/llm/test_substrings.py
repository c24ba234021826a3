"""Substring duplicates against windows counted by hand."""

import hashlib
import random
from collections import Counter

import numpy as np

from flowlens.llm import automata
from tests.llm.conftest import by_id


def by_hand(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        spans = [(k, next(e for e in range(k, len(w) + 1) if e not in gone)) for k in sorted(gone) if k - 1 not in gone]
        out.append((len(w), len(gone), hashlib.sha256(left).hexdigest(), spans))
    return out


def compared(spark, texts, window, parts=4):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    got = by_id(automata.repeats(docs, window))
    for i, want in enumerate(by_hand(texts, window)):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], [(s["start"], s["end"]) for s in r["removed"]]) == want, (i, texts[i][:80])
    return got


def test_spans_equal_counted_windows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    fresh = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, other = fresh(60), fresh(45)
    texts = [fresh(rng.randint(0, 200)) for _ in range(40)]
    texts += [f"{fresh(30)} {passage} {fresh(20)}", f"{passage}\n{fresh(3)}\t{other}", f"{other[:-3]} end {passage[4:]}", f"{fresh(80)} {other} {fresh(9)} {other}"]
    texts += [fresh(34), fresh(35), "a " * 34, "a " * 35, "a " * 36, "a b " * 50, "A b " * 20, None, "", " \t\n"]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1] + " more", f"é 日本 {texts[2]}"]
    edited = (base := fresh(300)).split()
    for k in range(0, 300, 41):
        edited[k] = "edit"
    texts += [base, " ".join(edited), fresh(20000)]
    got = compared(spark, texts, 35)
    assert sum(r["n_removed"] for r in got.values()) > 500


def test_short_and_long_windows(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(60)]
    for window in (1, 5, 8, 70):
        compared(spark, texts, window)


def test_a_line_of_very_many_texts(spark):
    """More distinct surroundings of one anchor than an automaton should hold; some of them repeat."""
    rng = random.Random(5)
    line = " ".join(f"line{k}" for k in range(20))
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join([*rng.choices(words, k=25), line, *rng.choices(words, k=25)]) for _ in range(automata.CROWD + 300)]
    texts += [f"x{k} {t} y{k}" for k, t in enumerate(texts[:5])] + [f"{' '.join(texts[9].split()[20:60])} {k}" for k in range(3)]
    got = compared(spark, texts, 35)
    assert {k for k, r in got.items() if r["n_removed"]} >= {0, 1, 2, 3, 4, 9}
    assert got[20]["n_removed"] == 0


def test_odd_and_no_rows(spark, odd_docs, no_docs):
    got = automata.repeats(odd_docs, 5).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_removed for r in got if r.doc_id in (7, 8)} == {40000, 18}
    assert all(r.n_removed == 0 for r in got if r.doc_id in (1, 2, 3, 4, 5, 6, 10))
    assert [r.n_words for r in got if r.doc_id is None] == [5]
    assert automata.repeats(no_docs, 5).collect() == []
    same_id = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e g"), (1, "x y z x y z"), (1, "p q r s t")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in automata.repeats(same_id, 5).collect()) == [
        (False, 5, 0), (False, 6, 0), (True, 6, 5), (True, 6, 5)]


def test_automaton_statistics():
    stretches = [[1, 2, 3, 4, 5], [9, 2, 3, 4, 8], [7, 7, 7, 7], [6, 1, 2]]
    automaton = automata.SuffixAutomaton(stretches, [1, 1, 1, 2])
    assert automaton.statistics(stretches[0]) == [1, 2, 2, 3, 0]
    assert automaton.statistics(stretches[2]) == [1, 2, 3, 3]
    assert automaton.statistics(stretches[3]) == [1, 2, 3]  # two copies of all of it
    assert automaton.statistics([2, 3, 4, 5, 77, 1]) == [1, 2, 3, 0, 0, 1]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 3000, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    (first, anchor), = automata.anchors(h, np.array([0, len(h)]), 12)
    ends = [*first[1:], len(h) - 11]
    seen = {}
    for a, b, key in zip(first, ends, anchor):
        for i in range(a, b):
            assert seen.setdefault(tuple(h[i : i + 12]), key) == key
    assert list(automata.anchors(h[:5], np.array([0, 5]), 12))[0][0].size == 0
