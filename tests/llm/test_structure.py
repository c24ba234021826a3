"""Conversation repair and Merkle manifest against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from flowlens.llm import conversations, merkle
from tests.llm.conftest import by_id

RIGHT = re.compile(r"(s?(ua)+)?")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def faults_of(lines):
    seen, out = set(), []
    for role, text in lines:
        stripped = text.strip(" \t\n\v\f\r")
        out.append("b" if not stripped else "d" if (role, text) in seen else "t" if stripped[-1] not in ".!?" else "n")
        seen.add((role, text))
    return out


def cheapest(lines):
    """Every way to edit at most a few lines, without graph or integers: (cost, audit, repaired lines)."""
    faults, best = faults_of(lines), None
    choices = [["D"] if f in "bd" else ["D", "K", "u", "a"] for f in faults]
    inserts = ["", "u", "a", "ua", "au"]
    for picks in itertools.product(*choices):
        for extra in itertools.product(inserts, repeat=len(lines) + 1):
            cost, audit, made = 0, "", []
            for i in range(len(lines) + 1):
                for role in extra[i]:
                    cost, audit = cost + 5, audit + "I"
                    made.append(({"u": "user", "a": "assistant"}[role], ""))
                if i == len(lines):
                    break
                p, (role, text) = picks[i], lines[i]
                audit += {"D": "D", "K": "K"}.get(p, "R")
                cost += {"D": 2, "K": 0}.get(p, 1) + (5 if faults[i] == "t" and p != "D" else 0)
                if p != "D":
                    made.append(({"u": "user", "a": "assistant"}.get(p, role), text))
            if RIGHT.fullmatch("".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
    return best


def plain(spark, convs):
    rows = [(c, t, r, x, 1) for c, lines in convs.items() for t, (r, x) in enumerate(lines)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")


def reported(df):
    return {r.conv_id: r.asDict() for r in df.collect()}


def test_repairs_equal_all_edits_tried(spark):
    rng = random.Random(5)
    texts = ["Fine.", "Good!", "cut", " ", "Why?"]
    convs = {c: [(rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(texts)) for _ in range(rng.randint(1, 3))] for c in range(60)}
    found = reported(conversations.repair(plain(spark, convs), plain(spark, convs)))
    for c, lines in convs.items():
        cost, audit, made = cheapest(lines)
        want = (cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made)))
        assert (found[c]["cost"], found[c]["audit"], found[c]["repaired_sha256"]) == want, lines
        assert [found[c][k] for k in ("blank", "duplicate", "truncated")] == [faults_of(lines).count(k) for k in "bdt"]


def test_long_conversations_are_cut_and_repaired_as_a_whole(spark):
    """A conversation of many pieces gets the answer of one graph over all its lines."""
    rng = random.Random(6)
    lines = [(rng.choice(["user", "assistant", "user", "assistant", "system"]), f"{i} {rng.choice(['ok.', 'cut', 'no!'])}") for i in range(3000)]
    convs = {1: lines, 2: [("user", "Hi."), ("assistant", "Yes.")]}
    table = plain(spark, convs)
    assert conversations.pieces(table).where("conv_id = 1").count() >= 5
    found = reported(conversations.repair(table, table))
    faults = "".join(faults_of(lines))
    initials, width = "".join(r[0] for r, _ in lines), 3 * (len(lines) + 1)
    whole = conversations.weights(faults, initials, [0, None, None, 0], True, width)[conversations.START]
    audit = conversations.letters_of(whole, width)
    assert (found[1]["cost"], found[1]["audit"]) == (whole >> (conversations.DIGIT * width), audit)
    made = []
    for line, state, letter in conversations.walk(conversations.START, audit, initials):
        if letter != "D":
            role = lines[line][0] if letter == "K" else "user" if state == conversations.USER else "assistant"
            made.append(f"{role}:{'' if letter == 'I' else lines[line][1]}")
    assert found[1]["repaired_sha256"] == sha("\n".join(made))
    assert RIGHT.fullmatch("".join(m[0] for m in made))
    assert (found[2]["cost"], found[2]["audit"]) == (0, "KK")


def test_odd_conversations(spark):
    rows = [(None, None, None, None, "x"), (None, 3, "user", "Hi.", "x"), (1, None, "", "Odd.", "x"), (1, 5, "user", "word " * 60000 + ".", "x"),
            (1, 5, "user", "Same.", "x"), (1, 5, "user", "Same.", "x"), (1, 9, "assistant", "Yes.", "x"), (2, 1, "user", "\t\n", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string").selectExpr("*", "text AS digest", "1 AS copies", "role AS first")
    found = reported(conversations.repair(table, table.select("conv_id", "turn", "role", "text", "copies").fillna(" ")))
    assert set(found) == {None, 1, 2}
    assert (found[None]["gaps"], found[None]["blank"]) == (0, 1) and set(found[None]["audit"]) == {"D"}
    assert (found[1]["gaps"], found[1]["duplicate"], found[1]["illegal"]) == (3, 1, 3)
    assert (found[2]["audit"], found[2]["cost"], found[2]["repaired_sha256"]) == ("D", 2, sha(""))
    assert set(reported(conversations.repair(table))) == {None, 1, 2}
    assert conversations.repair(table.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! three") for c in range(40) for t in range(5)]
    left = {}
    for r in conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        left[r.conv_id, r.turn] = (r.role, r.text, r.copies)
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: None, 1: (role, "", 1), 2: (role, "One Two three", 1), 3: (role, text, 2), 4: ("user", text, 1)}.get(draw, (role, text, 1))
        assert left.get((c, t)) == want


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(root, siblings of each leaf), level by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(nodes):
                proofs[k].append((i & 1, nodes[i ^ 1]))
            else:
                proofs[k].append((None, ""))
        at = [i // 2 for i in at]
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def manifest_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, sha("".join(map(field, r)))))
    for members in groups.values():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf for _, leaf in groups[g]]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for (r, leaf), low in zip(groups[g], trees[g][1]):
            path = low + tops[k]
            doc_id, source, lang, n_chars, text = r
            now = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                now = sha("".join(map(field, (doc_id, source, lang, None if n_chars is None else n_chars + 1, text))))
            for side, other in path:
                now = sha(now) if side is None else sha(other + now) if side else sha(now + other)
            out.append((doc_id, leaf, trees[g][0], root, sha("".join(o for _, o in path)), now, now == root))
    return out


@pytest.mark.parametrize("langs, n", [(["en"], 1), (["en", None, "de"], 5), (["é", "z", None, "a", "b"], 4000)])
def test_manifest_equals_hand_made_trees(spark, langs, n):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        rows.append((rng.choice([k, -k, 70 * k, 2**40 + k, None, 7]), rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 3]), rng.choice(["", None, "tëxt", str(k)])))
    rows += rows[: n // 3]  # repeated rows
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    clash = table.selectExpr("*", *[f"'?' AS `{c}`" for c in ("id", "grp", "leaf", "at", "row", "word", "n", "bits", "slot", "path", "part")])
    got = [tuple(r) for r in merkle.manifest(clash).collect()]
    assert sorted(got, key=str) == sorted(manifest_by_hand(rows), key=str)


def test_ranks_come_from_bitmaps(spark):
    ids = [(i, g) for i in (-130, -1, 0, 62, 63, 64, 65, 70000, 2**62, -(2**63)) for g in ("a", "b") if (i, g) != (0, "b")]
    rows = spark.createDataFrame([(i, g, f"{i}{g}") for i, g in ids], "id long, grp string, leaf string")
    for r in merkle.places(rows).collect():
        assert r["at"] == sum(j < r["id"] for j, g in ids if g == r["grp"])


def test_manifest_of_odd_and_no_rows(odd_docs, no_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit(None).cast("string"))
    got = merkle.manifest(docs).collect()
    assert len(got) == docs.count() and len({r.root for r in got}) == 1
    assert all(r.verified for r in got if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7)
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_tampering_is_found(spark):
    rows = [(i, "s", "en", 5, "x") for i in range(500)]
    got = by_id(merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")))
    assert {i for i, r in got.items() if not r["verified"]} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 7 == 0}
