import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import hpylm, mixing, quality, queries, rules, toxicity, url_filter
from tests.llm.conftest import ROWS, by_id

RULES = queries.URL_RULES


def brute_rule(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max((r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_url_rules_and_trees(spark):
    rng = random.Random(4)
    urls = [None, "", "abc", "HTTP://WWW.Example.COM/en/x?y#z", "http://com/", "http://a.com", "x://b.net/es/?u=http://c.com/", "http://xcom/", "a\nb://é.NET/fr/\nq", "://", "a://?x", "a:///en/"]
    urls += [f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example', 'ab1'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnsRenamed({}).selectExpr("*", "'x' AS host", "'y' AS score")
    got = {r.page_id: r for r in url_filter.classify(pages, RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = brute_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block") and 0 <= got[i].score <= 1
    only = url_filter.classify(pages.where("url LIKE '%.com/%' OR url IS NULL"), RULES[:1]).collect()
    assert {r.verdict for r in only} == {"allow"}
    assert url_filter.classify(pages.limit(0), RULES).count() == 0


def test_trees_learn_what_the_rules_say(spark):
    rows = [(i, f"http://h{i % 7}.{tld}/{'p' * (i % 5)}/{i}") for i in range(400) for tld in (("com", "net")[i % 2],)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    taught = (url_filter.Rule("allow", "h1.com/"), url_filter.Rule("allow", "h2.com/"), url_filter.Rule("block", "h3.net/"), url_filter.Rule("block", "h4.net/"))
    free = url_filter.classify(pages, taught).where("rule IS NULL").collect()
    assert sum((r.verdict == "allow") == r.host.endswith(".com") for r in free) / len(free) > 0.95


def brute_targets(sizes, weights, percent, cap):
    """Reshare the excess by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, total = {s: weights[i % len(weights)] for i, s in enumerate(names)}, sum(sizes.values()) * percent / 100
    full: dict = {}
    while True:
        rest, open_ = total - sum(full.values()), [s for s in names if s not in full]
        target = {**full, **{s: rest * w[s] / sum(w[x] for x in open_) for s in open_}}
        above = [s for s in open_ if target[s] > cap * sizes[s]]
        if not above:
            return target
        full.update({s: cap * sizes[s] for s in above})


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * int(rng.expovariate(1 / 80)) + ["x"]), rng.choice(["hot"] * 8 + list("abcdef") + [None, "é"])) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = by_id(mixing.mix(df))
    sizes = Counter()
    for i, t, s in docs:
        sizes[s] += len(t.split())
    want = brute_targets(sizes, (5, 2, 1), 150, 2)
    taken = Counter()
    for i, t, s in docs:
        r = got[i]
        assert r["size"] == len(t.split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.01)
    assert by_id(mixing.mix(df.repartition(7)).drop("rate")) == {i: {k: v for k, v in r.items() if k != "rate"} for i, r in got.items()}
    copies = Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert copies == {i: r["copies"] for i, r in got.items() if r["copies"]}


def test_mix_follows_the_rates_in_small_sources(spark):
    """500 documents a source, of which the one with weight 1 is to give a tenth of its words."""
    rng = random.Random(13)
    docs = [(500 * k + i, " ".join(["w"] * rng.randint(1, 300)), "abc"[k]) for k in range(3) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = sorted(mixing.mix(df, weights=(7, 7, 1), percent=50).collect(), key=lambda r: (r.doc_id // 500, r["size"]))
    for k in range(3):
        of = rows[500 * k : 500 * k + 500]
        assert k < 2 or of[0].target / of[0].source_size == pytest.approx(0.1, abs=0.01)
        assert sum(r.taken for r in of) == pytest.approx(of[0].target, rel=0.01)
        for at in range(0, 500, 100):
            part = of[at : at + 100]
            assert sum(r.copies for r in part) == pytest.approx(sum(r.rate for r in part), abs=3)
            assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in part)


def test_mix_of_many_documents_of_one_size(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1, 3), percent=70).collect()
    for n, of in ((2000, [r for r in got if r.doc_id % 3]), (1000, [r for r in got if r.doc_id % 3 == 0])):
        assert len(of) == n and sum(r.copies for r in of) == pytest.approx(of[0].target / 3, abs=1)


def test_tilt_solves_the_dual(spark):
    rng = np.random.default_rng(6)
    size = rng.integers(1, 300, 500)
    sizes = spark.createDataFrame([("s", int(x)) for x in size], "source string, size long")
    for factor, length in ((0.6, 1.0), (1.7, 0.95), (1.2, 1.1)):
        targets = spark.createDataFrame([("s", int(size.sum()), 500, float(size.sum() * factor))], "source string, source_size long, n_docs long, target double")
        r = mixing.balanced_rates(sizes, targets, 2.0, length).first()
        rate = np.minimum(2.0, np.exp(r.a + r.b * size / size.mean()))
        assert (rate * size).sum() == pytest.approx(size.sum() * factor, rel=1e-4)
        assert rate.sum() == pytest.approx(500 * factor / length, rel=1e-4)


def test_mix_balances_lengths(spark):
    """A source of long and one of short documents come nearer to the mean of both; with equal rates neither would move."""
    rng = random.Random(17)
    docs = [(600 * k + i, " ".join(["w"] * rng.randint(*((1, 120), (60, 300))[k])), "ab"[k]) for k in range(2) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), weights=(1, 3), percent=60).collect()
    overall = sum(r["size"] for r in got) / len(got)
    for k, sign in ((0, 1), (1, -1)):
        of = [r for r in got if r.doc_id // 600 == k]
        before, after = sum(r["size"] for r in of) / len(of), sum(r.taken for r in of) / sum(r.copies for r in of)
        assert before * 1.02 ** sign * sign < after * sign <= overall * sign * 1.01 ** sign
        assert sum(r.taken for r in of) == pytest.approx(of[0].target, rel=0.01)
        assert len({round(r.rate, 3) for r in of}) > 20


def test_mix_of_odd_rows(odd_docs, no_docs):
    got = by_id(mixing.mix(odd_docs))
    assert {i: r["size"] for i, r in got.items() if i in (1, 2, 3, 4, 7)} == {1: 0, 2: 0, 3: 0, 4: 2, 7: 40000}
    assert got[1]["taken"] == 0 and got[None]["source_size"] == 7
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed(odd_docs).columns == odd_docs.columns and mixing.mixed(no_docs).count() == 0


def labelled(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "le", "la", "und", "of"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(15, 60))]
        bad = rng.random() < 0.3
        toxic = not bad and rng.random() < 0.4
        if toxic:
            text.insert(rng.randrange(len(text)), "vile" + rng.choice(["st", "", "ness", "ly", "r"]))
        if bad:
            text = rng.choice([[w.upper() + "!!" for w in text], [w + "***" for w in text], [text[0]] * len(text), [w + " |" for w in text]])
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_quality_and_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(random.Random(7), 1500)
    df, truth = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = {i: (q, t) for i, q, t in labels}
    for got, at, cut in ((quality.score_quality(df, truth), 0, 0.3), (toxicity.score_toxicity(df, truth), 1, 0.5)):
        rows = got.collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        held = [r for r in rows if r.held_out]
        assert sum(r.predicted == known[r.doc_id][at] for r in held) / len(held) > 0.97
    found = toxicity.offending(df, truth).collect()
    assert sum("vile" in r.text for r in found) / len(found) > 0.9


def test_quality_cut_is_a_quantile_of_all_labelled_documents(spark, monkeypatch):
    """Labels that overlap in their features, and far more of them than the fit may use."""
    monkeypatch.setattr(quality, "SAMPLE", 60)
    rng = random.Random(14)
    labels = [(i, int(rng.random() < 0.6), 0) for i in range(2000)]
    docs = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) + "!" * (rng.random() < (0.3 if q else 0.5)) for _ in range(40))) for i, q, _ in labels]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learned = [r for r in quality.score_quality(df, known).collect() if not r.held_out]
    quality_of = {i: q for i, q, _ in labels}
    assert sum(not r.predicted for r in learned) == pytest.approx(sum(not quality_of[r.doc_id] for r in learned), abs=2)


def test_scores_around_a_rank(spark):
    values = [(float(v), n) for v, n in ((3, 2), (1, 1), (2, 3), (5, 1), (1, 1), (9, 4))]
    scores, flat = spark.createDataFrame(values, "s double, n long"), sorted(v for v, n in values for _ in range(n))
    for rank in (1, 2, 5, 7, 11):
        assert quality._around(scores, rank) == (flat[rank - 1], flat[rank])


def test_labels_of_held_out_documents_change_nothing(spark):
    docs, labels = labelled(random.Random(8), 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    one, two = (spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (labels, flipped))
    assert by_id(quality.score_quality(df, one)) == by_id(quality.score_quality(df, two))
    a, b = (by_id(toxicity.score_toxicity(df, x)) for x in (one, two))
    assert all(a[i]["score"] == pytest.approx(b[i]["score"], abs=1e-9) for i in a)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (4, None, None), (7, 7, 7)]])
def test_scores_of_odd_rows(spark, odd_docs, no_docs, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert len(by_id(score(odd_docs, known))) == len({i for i, *_ in ROWS}) and score(odd_docs, known).count() == len(ROWS)
        assert score(no_docs, known).count() == 0
    assert quality.good(odd_docs, known).count() == len(ROWS)


def test_sentences_split_and_count_words_once():
    s = toxicity.sentences(pa.array(["One two, one! Three\nfour", None, "..", ""]))
    assert np.diff(s.rows).tolist() == [3, 1, 2, 1] and np.diff(s.starts).tolist() == [2, 1, 1, 0, 0, 0, 0]


def test_rules_equal_sql_where_cutoffs_pass(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(6000):
        words = [rng.choice("abcdefghij") * rng.randint(2, 6) for _ in range(rng.randint(18, 40))]
        if i % 9 == 0:
            words = [w + "!#"[i % 2] * 3 for w in words]
        if i % 50 == 0:
            words[8:8] = words[:8]
        docs.append((i, " ".join(words) + "\n" + rng.choice(["x y\nx y", " \n", "É!"]), rng.choice(["en", "en", None])))
        labels.append((i, int(i % 9 != 0)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    con.register("labels", known.toArrow())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.OP8_SQL})").fetchall())
    got = sorted(tuple(r) for r in rules.judge(df, known).select(*names).collect())
    assert got == want
    assert any(not r[6] and not r[7] for r in got)


def test_binomial_tail(spark):
    for n, k, p in ((50, 0, 0.01), (1000, 3, 0.02), (5000, 40, 0.01), (10, 9, 0.01), (0, 0, 0.5)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0
        got = spark.range(1).selectExpr(f"{n}L AS n", f"{k}L AS k").select(rules.binomial_tail(rules.F.col("n"), rules.F.col("k"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_rules_of_odd_rows(odd_docs, no_docs, no_labels):
    got = by_id(rules.judge(odd_docs, no_labels))
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[4]["kept"]
    assert got[7]["n_words"] == 40000 and got[7]["n_repeat_words"] == 40000 and got[11]["n_symbols"] == 4
    assert rules.judge(odd_docs, no_labels).count() == len(ROWS) and rules.judge(no_docs, no_labels).count() == 0


def test_language_model_base_scores_equal_brute_force(spark):
    rng = random.Random(10)
    words = ["der", "die", "haus", "the", "house", "a|b", "É", "x" * 40]
    docs = [(i, " ".join(rng.choice(words[:4] if i % 2 else words[3:]) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(900, None), (901, "only here once")]
    out = by_id(hpylm.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    ours, base = (sum(r[k] for i, r in out.items() if held[i]) for k in ("score", "base_score"))
    assert ours > base


def test_language_model_probabilities_sum_to_one(spark):
    """One-word texts: over all first words that were learned and the unknown event the probabilities add up to one."""
    docs = [(i, w) for i, w in enumerate("red red red blue blue green red blue white red".split() * 30)]
    docs += [(1000 + i, w) for i, w in enumerate(["red", "blue", "green", "white", "never", ""])]
    out = by_id(hpylm.score_texts(spark.createDataFrame(docs, "doc_id long, text string")))
    # every text here is word + end, and after each word only the end was ever seen
    after = {w: out[1000 + k]["score"] for k, w in enumerate(["red", "blue", "green", "white"])}
    assert sum(10**s for s in after.values()) == pytest.approx(1, abs=0.1)


def test_spelling_contexts_sum_to_one():
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 3, (hpylm.SYMBOLS,) * 3).astype(float) * (rng.random((hpylm.SYMBOLS,) * 3) < 0.01)
    p, tables = hpylm.context_seating(counts, np.full(hpylm.SYMBOLS, 1 / hpylm.SYMBOLS), rng)
    assert np.allclose(p.sum(axis=-1), 1) and tables.sum() <= counts.sum()


def posterior(customers, d, chance):
    """Exact, by t, from all arrangements of so many customers at t tables; ``chance(t)`` is the weight of one more after t."""
    weight = {1: 1.0}
    for k in range(1, customers):
        after = Counter()
        for t, w in weight.items():
            after[t + 1] += w * chance(t)
            after[t] += w * (k - d * t)
        most = max(after.values())  # only keeps the numbers small
        weight = {t: w / most for t, w in after.items()}
    return {t: w / sum(weight.values()) for t, w in weight.items()}


@pytest.mark.parametrize("customers, d, others, parent", [
    (6, 0.6, 50, 0.02), (2, 0.5, 0, 0.3), (5, 0.3, 4, 0.9), (40, 0.8, 1000, 0.01), (300, 0.5, 20, 1e-9), (400, 0.6, 500, 0.05),
])
def test_seating_has_the_enumerated_posterior(customers, d, others, parent):
    """Dishes that start at the fewest tables, after 50 Gibbs steps."""
    rng, many = np.random.default_rng(12), 4000
    strength = 1 + d * others
    exact = posterior(customers, d, lambda i: (strength + d * i) * parent)
    tables = np.ones(many)
    for _ in range(50):
        tables = hpylm.seated(np.full(many, customers), tables, np.full(many, strength), np.full(many, parent), d, rng)
    got = Counter(tables.astype(int).tolist())
    assert sum(abs(got[t] / many - p) for t, p in exact.items()) / 2 < 0.06
    assert tables.mean() == pytest.approx(sum(t * p for t, p in exact.items()), rel=0.02)


@pytest.mark.parametrize("customers, d, free, q, grows", [(6, 0.6, 31, -0.59, 200.0), (30, 0.5, 4, 3.0, 40.0), (200, 0.8, 10, 20.0, 900.0)])
def test_seating_counts_its_own_tables_in_the_parent(customers, d, free, q, grows):
    rng, many = np.random.default_rng(13), 4000
    exact = posterior(customers, d, lambda i: (free + d * i) * (q + i) / (grows + i))
    tables = np.ones(many)
    for _ in range(50):
        tables = hpylm.seated(np.full(many, customers), tables, np.full(many, free), np.full(many, q), d, rng, np.full(many, grows))
    got = Counter(tables.astype(int).tolist())
    assert sum(abs(got[t] / many - p) for t, p in exact.items()) / 2 < 0.06


def test_seating_of_many_dishes_is_bounded():
    """The temporary numbers of a step must not grow with the shard; before, these took 215 MB."""
    rng, many = np.random.default_rng(2), 1_000_000
    customers, ones = rng.integers(2, 20, many), np.ones(many)
    tracemalloc.start()
    tables = hpylm.seated(customers, ones, 5 * ones, 0.01 * ones, 0.5, rng)
    words = pa.array(["abcdefghi"] * 200_000, pa.large_string())
    hpylm.spelling(words, np.full(hpylm.SYMBOLS**4, -3.0, np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert (tables >= 1).all() and (tables <= customers).all()


def test_steps_get_one_shard_at_a_time(spark):
    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows for b in batches]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, state = spark.conf.get(key), spark.range(0, 6, 1, 1)
    with hpylm._row_by_row(spark):
        assert [r.n for r in state.mapInArrow(sizes, "n long").collect()] == [1] * 6
    assert spark.conf.get(key) == before


def test_language_model_does_not_depend_on_the_layout(spark, monkeypatch):
    rng = random.Random(14)
    docs = [(i, " ".join(rng.choice(["a", "b", "cat", "dog"]) + rng.choice(["", "s"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    monkeypatch.setattr(hpylm, "SHARD_BYTES", 5_000)  # several shards
    frame, usual = spark.createDataFrame(docs, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions")
    first = by_id(hpylm.score_texts(frame.repartition(1)))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        second = by_id(hpylm.score_texts(frame.repartition(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert all(r["score"] == pytest.approx(second[i]["score"], rel=1e-5) for i, r in first.items())


def test_language_model_of_odd_rows(odd_docs, no_docs):
    got = hpylm.score_texts(odd_docs).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 for r in got)
    assert hpylm.score_texts(no_docs).count() == 0


def test_counts_of_a_spelling_context_are_added_one_by_one():
    """A group has a row from each task; before, all of them were held together."""
    cells = np.arange(hpylm.SYMBOLS**3, dtype=np.int32)

    def sent(tasks):
        for i in range(tasks):
            rows = [[5], [cells.tobytes()], [np.full(len(cells), float(i)).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.binary(), pa.binary()))], names=["last", "events", "n"])

    before = pa.total_allocated_bytes()
    tracemalloc.start()
    last, cube = hpylm._cube(sent(200))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last == 5 and cube.shape == (hpylm.SYMBOLS,) * 3 and (cube == sum(range(200))).all()
    assert peak < 12_000_000 and pa.total_allocated_bytes() - before < 4_000_000  # the rows are 265 MB
