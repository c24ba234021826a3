import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowlens.llm import mixing
from tests.llm.conftest import ROWS
from tests.llm.test_dedup import brute
from tests.llm.test_text_operators import WORDS, brute_contamination

STAGES = [f for _, f in corpus_pipeline.STAGES]


def write(spark, folder, documents, labels, items):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def corpus(rng):
    words = [f"{rng.choice('abcdefg')}{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if i % 6 == 1:  # near copy of the document before
            text = docs[-1][1].replace("!!", "").split()
            text[len(text) // 2] = "changed"
        if i % 25 == 2:
            text[10:10] = rng.choice(items)[1].upper().split()
        good = i % 5 != 3
        docs.append((i, " ".join(text if good else [w.upper() + "!!" for w in text]), "en", rng.choice(["hot", "hot", "b", None])))
        labels.append((i, int(good), 0))
    return docs, labels, items


def test_every_stage_against_brute_force(spark, tmp_path):
    documents, labels, items = corpus(random.Random(3))
    d = write(spark, tmp_path, documents, labels, items)
    docs, text = spark.read.parquet(f"{d}/documents.parquet"), {i: t for i, t, *_ in documents}

    good = STAGES[0](spark, docs, d)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i, q, _ in labels if q == 1}

    first = STAGES[1](spark, good, d)
    groups = brute([(i, text[i]) for i in kept], 5, 80)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {i for i, g in groups.items() if g[2]}

    clean = STAGES[2](spark, first, d)
    want = {r.doc_id for r in first.collect() if not brute_contamination(text[r.doc_id], items, 13)[4]}
    assert {r.doc_id for r in clean.collect()} == want and len(want) < first.count()

    mix = STAGES[3](spark, clean, d)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert mix.columns == docs.columns and Counter(r.doc_id for r in mix.collect()) == copies

    index = sorted(STAGES[4](spark, mix, d).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in index) == copies and [r.doc_id for r in index] == sorted(r.doc_id for r in index)
    library = Tokenizer.from_file(WORDS)
    for r in index[:50]:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())

    whole = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, d).collect())
    assert whole == sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in index)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, odd_docs, tmp_path, empty):
    d = write(spark, tmp_path, [], [], [])
    docs = odd_docs.limit(0) if empty else odd_docs
    for stage in STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() <= 2 * docs.count()
    assert STAGES[-1](spark, docs, d).count() == (0 if empty else len(ROWS))
