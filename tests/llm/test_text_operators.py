import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowlens.llm import decontaminate, token_counts, token_file, tokens
from flowlens.llm.tokens import TextEncoder
from flowlens.session import work_path
from tests.llm.conftest import LONG, ROWS, by_id

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def texts():
    rng = random.Random(1)
    parts = ["a", "B", "é", "'", "s", ".", " ", "\n", "  ", "1", ",", "\t", "É", "l", "|", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "…", "$", "don't "]
    out = [None, "", " ", "\n", "  a b  c", " x\ny\n\nz", "ΣΑΣ İI", "日本語 テキスト。", "x" * 3000, "ﬁ Ⅷ ½ a\x1cb\x85", "A\r\nB", "é e ́x"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    encoder, library, given = TextEncoder(path), Tokenizer.from_file(path), texts()
    for _ in range(2):  # without and with the cache filled
        ids, starts = encoder.encode(pa.array(given, pa.string()))
        for i, e in enumerate(library.encode_batch([t or "" for t in given], add_special_tokens=False)):
            assert ids[starts[i] : starts[i + 1]].tolist() == e.ids, given[i]
        assert (encoder.counts(pa.array(given, pa.string())) == np.diff(starts)).all()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_on_slices(path):
    encoder, library, given = TextEncoder(path), Tokenizer.from_file(path), texts()
    for at, size in ((1, 5), (700, 100), (1500, 12)):
        ids, starts = encoder.encode(pa.array(given, pa.string()).slice(at, size))
        for i, t in enumerate(given[at : at + size]):
            assert ids[starts[i] : starts[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr("flowlens.llm.tokens.CACHED", 5)
    encoder, library = TextEncoder(WORDS), Tokenizer.from_file(WORDS)
    for t in ("one two three", "four five. six! seven", "one nine ten eleven twelve thirteen"):
        assert encoder.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_counts_with_and_without_cache(spark, odd_docs):
    library, cache = Tokenizer.from_file(BYTES), work_path(spark, "test-cache")
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS}
    for rows in (len({t or "" for _, t, _ in ROWS}),) * 2:  # the second run adds nothing
        out = token_counts.count_tokens(odd_docs, BYTES, cache, over=512)
        assert out.count() == len(ROWS)
        assert {i: (r["n_bytes"], r["n_tokens"]) for i, r in by_id(out).items()} == want
        assert {i for i, r in by_id(out).items() if r["over_limit"]} == {7}
        assert spark.read.parquet(cache).count() == rows
    assert token_counts.count_tokens(odd_docs, WORDS, cache).count() == len(ROWS)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_counts_of_no_rows(spark, no_docs):
    assert token_counts.count_tokens(no_docs, BYTES, work_path(spark, "test-cache")).count() == 0


def test_token_counts_leave_no_cache_in_workers(spark, odd_docs):
    token_counts.count_tokens(odd_docs, WORDS, work_path(spark, "test-cache")).count()

    def kept(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"n": [len(e.keys) for e in tokens._ENCODERS.values()]}, pa.schema([("n", pa.int64())]))

    assert max([r.n for r in spark.range(0, 64, 1, 64).mapInArrow(kept, "n long").collect()], default=0) == 0


def test_token_files_round_trip(spark, odd_docs):
    files = token_file.write_tokens(odd_docs, WORDS, work_path(spark, "test-tokens"), end_id=1)
    got = sorted(files.documents().collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(WORDS), 0
    assert len(got) == len(ROWS) and [r.doc_id for r in got] == sorted((i for i, *_ in ROWS), key=lambda i: -1 if i is None else i)
    text = {i: t or "" for i, t, _ in ROWS}
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shards = files.shards().orderBy("shard").collect()
    assert sum(s.n_ids for s in shards) == at
    last = token_file.mapped(files.folder, shards[-1].offsets, "<u8")
    assert last[-1] == at and len(last) == shards[-1].n_docs + 1
    assert len(token_file.mapped(files.folder, shards[0].tokens, files.kind)) == shards[0].n_ids


def test_token_files_leave_no_cache_in_workers(spark, odd_docs):
    """Workers go on to other steps, which have the memory then."""
    token_file.write_tokens(odd_docs, WORDS, work_path(spark, "test-tokens"), end_id=1)

    def kept(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"n": [len(e.keys) for e in tokens._ENCODERS.values()]}, pa.schema([("n", pa.int64())]))

    assert max([r.n for r in spark.range(0, 64, 1, 64).mapInArrow(kept, "n long").collect()], default=0) == 0


def test_token_files_of_no_rows(spark, no_docs):
    assert token_file.write_tokens(no_docs, WORDS, work_path(spark, "test-tokens"), end_id=1).documents().count() == 0


def fold(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or c in "0123456789" or "a" <= c <= "z" else " " for c in text or "").split(" ") if w]


def brute_contamination(text, items, size):
    words, hit, found = fold(text), set(), set()
    for item, other in items:
        w = fold(other)
        runs = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        for run in runs:
            for p in range(len(words) - len(run) + 1):
                if tuple(words[p : p + len(run)]) == run:
                    hit.update(range(p, p + len(run)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [500_000, 40])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("ab") + rng.choice(["", "é"]) for _ in range(rng.randint(0, 9)))) for i in range(12)]
    items += [(50, items[3][1]), (51, None), (52, "...")]
    docs = [(i, rng.choice([" ", "; ", "\n"]).join(rng.choice("abAB") + rng.choice(["", "é"]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    out = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size=5
    ).collect()
    text = dict(docs)
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(text[r.doc_id], items, 5)
        assert sum(len(fold(text[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit


def test_automata_of_a_large_benchmark_are_built_once_a_batch(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(900)]
    built = []
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(decontaminate, "automaton", lambda items, size, make=decontaminate.automaton: built.append(len(items)) or make(items, size))
    items = [(str(i), text) for i, text in enumerate(texts[:40])]
    blocks = decontaminate.items_in_blocks(spark.createDataFrame(items, "item_id string, text string"))
    assert len(blocks) > 2
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(900)), "text": texts})
    got = [r for piece in decontaminate._pieces(batch, len(blocks)) for r in decontaminate._scanned(piece, blocks, 13, 20).to_pylist()]
    assert len(built) == len(blocks) and sum(built) == 40
    assert [r["contaminated"] for r in got] == [i < 40 for i in range(900)]


def test_contamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox"), (None, "LOREM-ipsum"), (2, None), (2, "")], "item_id long, text string")
    got = by_id(decontaminate.contamination(odd_docs, items))
    assert {i for i, r in got.items() if r["contaminated"]} == {7, 8}
    assert got[7]["n_hit"] == 16000 and got[1]["n_words"] == 0 and got[3]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.clean(odd_docs, items).count() == len(ROWS) - 3
    assert decontaminate.clean(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.clean(odd_docs, items.limit(0)).count() == len(ROWS)
    assert len(LONG) > 100_000
