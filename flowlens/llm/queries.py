"""Registered queries of the operators in this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import automata, conversations, decontaminate, hpylm, merkle, minhash, mixing, quality, rules, token_counts, token_file, toxicity, url_filter
from flowlens.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A-Z to a-z only, and the words between ASCII white space.
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS_SQL.format(LOWER_SQL)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y USING (s)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE 100 * s.n >= 85 * (p.n + q.n - s.n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b FROM reach r JOIN links ON other = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


@query("op1_minhash_near_dedup", OP1_SQL)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


FOLDED_SQL = WORDS_SQL.replace("[\\x20\\x09-\\x0D]+", "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+").format(LOWER_SQL)

OP2_SQL = f"""
WITH words AS (SELECT doc_id, {FOLDED_SQL} AS w FROM documents),
items AS (SELECT item_id, {FOLDED_SQL} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, s, least(len(w), 13) AS size FROM (
  SELECT item_id, w, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
    lambda i: array_to_string(w[i:i + 12], ' '))) AS s FROM items WHERE len(w) > 0)),
runs AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS s FROM (
  SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p
  FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT DISTINCT doc_id, r.size, p, item_id FROM runs r JOIN windows v ON r.size = v.size AND r.s = v.s),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (
  SELECT doc_id, unnest(range(p, p + size)) AS q FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(g.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits h USING (doc_id) LEFT JOIN held g USING (doc_id)
"""


@query("op2_aho_corasick_decontamination", OP2_SQL)
def op2_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the spans, which the operator also returns."""
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13, share=20
    ).drop("spans")


URL_RULES = tuple(url_filter.Rule(verdict, text) for verdict, text in (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")
))


@query("op3_boosted_url_filter")
def op3_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.classify(table(spark, sf_dir, "pages"), URL_RULES)


@query("op4_digest_cache_token_counts")
def op4_digest_cache_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache that is new in each run, so every distinct text is encoded."""
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), work_path(spark, "token-cache"), over=512
    )


@query("op5_entropy_balanced_mix")
def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, cap=2).drop("rate", "copies")


@query("op6_token_file")
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_file.write_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), work_path(spark, "token-file"), end_id=1
    )
    return files.documents()


@query("op7_bradley_terry_quality")
def op7_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_noisy_or_toxicity")
def op10_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_STATS_SQL = " UNION ALL ".join(
    f"SELECT lang, q, '{name}' AS statistic, {a} AS a, {b} AS b FROM labelled" for name, (a, b) in rules.STATISTICS.items()
)
_RISK = rules.Risk()
_LOG_TERM = "lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})".format(
    p=_RISK.rejected / len(rules.STATISTICS)
)

OP8_SQL = f"""
WITH words AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
runs AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (
  SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM words WHERE len(w) >= 8))),
repeats AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM runs WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS kinds FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
stats AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n - kinds, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_neighbours, coalesce(l.n, 0) AS n_lines
  FROM words LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)),
labelled AS (SELECT s.*, 1 AS q FROM stats s WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
cells AS (SELECT lang, statistic, cutoff, count(*) AS n, count(*) FILTER (WHERE 100 * a > cutoff * b) AS k
  FROM ({_STATS_SQL}), (SELECT unnest({list(rules.CUTOFFS)}) AS cutoff) GROUP BY ALL),
cuts AS (SELECT lang, statistic, min(cutoff) AS cutoff FROM cells, (SELECT count(DISTINCT coalesce(lang, chr(0))) AS strata FROM labelled)
  WHERE k < n * {_RISK.rejected / len(rules.STATISTICS)} AND list_sum(list_transform(range(0, k + 1), lambda j: exp({_LOG_TERM})))
    <= {_RISK.error / len(rules.STATISTICS) / len(rules.CUTOFFS)} / strata GROUP BY ALL),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (
  {" OR ".join(f"coalesce(100 * {a} > {b} * (SELECT any_value(cutoff) FROM cuts c WHERE statistic = '{name}' AND c.lang IS NOT DISTINCT FROM judged.lang), false)" for name, (a, b) in rules.STATISTICS.items())}
) AS kept FROM judged
"""


@query("op8_risk_controlled_rules", OP8_SQL)
def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_pitman_yor_scores")
def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_texts(table(spark, sf_dir, "documents"))


#: crc32 of the ASCII string ``s``, with the table of the CTE ``crc``.
CRC_CTE = """crc AS (SELECT list(c ORDER BY i) AS c FROM (SELECT range AS i, list_reduce(list_prepend(CAST(range AS UBIGINT),
  [CAST(x AS UBIGINT) FOR x IN range(8)]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END) AS c FROM range(256)))"""
CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ord(s[k]) AS UBIGINT) FOR k IN range(1, len(s) + 1)]),
  lambda a, b: xor(a >> 8, c[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT))"""


def _field_sql(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


_PARENTS = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"
# a step of a proof: L or R with the sibling, N without one
_STEP = "CASE WHEN xor(i >> level, 1) >= len(nodes) THEN 'N' WHEN (i >> level) & 1 = 1 THEN 'L' || nodes[xor(i >> level, 1) + 1] ELSE 'R' || nodes[xor(i >> level, 1) + 1] END"

OP13_SQL = f"""
WITH RECURSIVE {CRC_CTE},
base AS (SELECT doc_id, coalesce(lang, chr(0)) AS g, lang, sha256({" || ".join(_field_sql(c) for c in merkle.FIELDS)}) AS leaf,
  sha256({" || ".join(_field_sql(c + " + 1" if c == "n_chars" else c) for c in merkle.FIELDS)}) AS changed,
  coalesce((SELECT {CRC_SQL} FROM crc, (SELECT CAST(doc_id AS VARCHAR) AS s)) % 7 = 0, false) AS tampered FROM documents),
rows AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base),
trees AS (SELECT g, 0 AS level, list(leaf ORDER BY i) AS nodes FROM rows GROUP BY g
  UNION ALL SELECT g, level + 1, {_PARENTS} FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS k FROM trees WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY k) AS nodes FROM subroots
  UNION ALL SELECT level + 1, {_PARENTS} FROM top WHERE len(nodes) > 1),
low AS (SELECT doc_id, g, i, list({_STEP} ORDER BY level) AS path FROM rows JOIN trees USING (g) WHERE len(nodes) > 1 GROUP BY ALL),
high AS (SELECT g, list({_STEP.replace("i >>", "k >>")} ORDER BY level) AS path FROM subroots, top WHERE len(nodes) > 1 GROUP BY g),
proofs AS (SELECT r.doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
  list_concat(coalesce(l.path, []), coalesce(h.path, [])) AS path, CASE WHEN tampered THEN changed ELSE leaf END AS used
  FROM rows r JOIN subroots USING (g) LEFT JOIN low l ON r.g = l.g AND r.i = l.i LEFT JOIN high h ON r.g = h.g),
folded AS (SELECT *, list_reduce(list_prepend(used, path), lambda a, p: sha256(CASE p[1] WHEN 'N' THEN a WHEN 'L' THEN p[2:] || a ELSE a || p[2:] END)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda p: p <> 'N'), lambda p: p[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


_MOVES = {0: ("su", "12"), 1: ("u", "2"), 2: ("a", "3"), 3: ("u", "2")}


def _options_sql(s: int) -> str:
    """The cheapest of what may be done with a line in state s, as {c, a}; v holds the best from each state behind it."""
    initials, states = _MOVES[s]
    kept = " ".join(f"WHEN ch = '{i}' AND f IN ('n', 't') THEN {{'c': t.c + v[{int(x) + 1}].c, 'a': 'K' || v[{int(x) + 1}].a}}".replace("t.c", "more") for i, x in zip(initials, states))
    after = 4 if s == 2 else 3
    return (f"list_sort(list_filter([{{'c': 2 + v[{s + 1}].c, 'a': 'D' || v[{s + 1}].a}}, CASE {kept} END, "
            f"CASE WHEN f IN ('n', 't') THEN {{'c': 1 + more + v[{after}].c, 'a': 'R' || v[{after}].a}} END], lambda o: o IS NOT NULL))[1]")


def _inserted_sql(v: str) -> str:
    best = ", ".join(f"list_sort([b[{s + 1}], {{'c': 5 + {v}[{n}].c, 'a': 'I' || {v}[{n}].a}}])[1]" for s, n in enumerate((3, 3, 4, 3)))
    return f"[{best}]"


OP11_SQL = f"""
WITH RECURSIVE {CRC_CTE},
base AS (SELECT coalesce(CAST(conv_id AS VARCHAR), 'none') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  (SELECT {CRC_SQL} FROM crc, (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s)) % 20 AS d FROM conversations),
damaged AS (SELECT g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM base WHERE d <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY g) AS n FROM damaged),
lines AS (SELECT g, i, n, turn, role, text, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS ch,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'n' END AS f FROM numbered),
paths AS (SELECT DISTINCT g, n + 1 AS i, [{{'c': 0, 'a': ''}}, {{'c': 10, 'a': 'II'}}, {{'c': 5, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS v FROM lines
  UNION ALL SELECT g, i, {_inserted_sql("w")} FROM (SELECT g, i, b, {_inserted_sql("b")} AS w FROM (
    SELECT l.g, l.i, [{", ".join(_options_sql(s) for s in range(4))}] AS b
    FROM paths p JOIN (SELECT *, CASE WHEN f = 't' THEN 5 ELSE 0 END AS more FROM lines) l ON l.g = p.g AND l.i = p.i - 1))),
best AS (SELECT g, v[1].c AS cost, v[1].a AS audit FROM paths WHERE i = 1),
edits AS (SELECT g, p, audit[p] AS e, len(regexp_replace(audit[:p], 'I', '', 'g')) AS i, len(regexp_replace(audit[:p], 'D', '', 'g')) AS q
  FROM (SELECT g, audit, unnest(range(1, len(audit) + 1)) AS p FROM best)),
made AS (SELECT e.g, p, e, q, l.role, coalesce(CASE WHEN e = 'I' THEN '' ELSE l.text END, '') AS text,
  max(CASE WHEN e = 'K' AND q = 1 AND ch = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.g) AS lead FROM edits e LEFT JOIN lines l ON l.g = e.g AND l.i = e.i),
repaired AS (SELECT g, string_agg(CASE WHEN e = 'K' THEN role WHEN (q - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM made WHERE e <> 'D' GROUP BY g),
pairs AS (SELECT g, ch || lead(ch) OVER (PARTITION BY g ORDER BY i) AS pair FROM lines),
counted AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate,
  count(*) FILTER (WHERE f = 't') AS truncated FROM lines GROUP BY g)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  (SELECT count(*) FROM pairs p WHERE p.g = c.g AND pair NOT IN ('su', 'ua', 'au')) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'none') AS g FROM conversations) c
LEFT JOIN counted USING (g) LEFT JOIN best USING (g) LEFT JOIN repaired USING (g)
"""


@query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
runs AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM words WHERE len(w) >= 35)),
again AS (SELECT s FROM runs GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS q FROM runs SEMI JOIN again USING (s)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY q) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM words) ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r)
"""


@query("op12_suffix_automaton_dedup", OP12_SQL)
def op12_suffix_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the spans, which the operator also returns."""
    return automata.repeats(table(spark, sf_dir, "documents"), window=35).drop("removed")
