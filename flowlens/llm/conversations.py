"""Structure of conversations: damage on purpose, find faults, and repair by the cheapest edits.

A repair is a path through a graph of boundaries between lines and of four states: nothing said yet, after the system line,
after a user line, after an assistant line. Each edge is an edit with a letter. A path weighs one integer: the cost in the
high digits, below it the letters in ``DIGIT``-bit digits of a fixed width, left-aligned and with zeros behind the last.
The smallest integer is the cheapest path and, of equally cheap ones, the first in ASCII order. At most one edit of a kind
leaves a node, so paths from a node differ in their first digit: digits never need to reach beyond a piece of lines, and
long conversations are cut into pieces that are solved apart, linked by the costs of the states at the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.merkle import same
from flowlens.session import drop_written, written

#: Lines in a piece, text bytes at which it ends earlier, bits of a letter.
PIECE, PIECE_BYTES, DIGIT = 512, 4_000_000, 3
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
CUT_SHORT = 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a kept line, by the state before and the initial of its role.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after an inserted or reroled line, by the state before.
NEXT = [USER, USER, ASSISTANT, USER]
#: Costs of the states behind the last line, with the insertions they still need.
END = [0, 2 * COST[INSERT], COST[INSERT], 0]


def _before(costs: list[int | None], width: int) -> list[int | None]:
    return [None if c is None else c << (DIGIT * width) for c in costs]


def _edge(letter: int, cost: int, rest: int | None, width: int) -> int | None:
    """The weight of a path that begins with this edit and goes on like ``rest``."""
    if rest is None:
        return None
    bits = DIGIT * width
    low = rest & ((1 << bits) - 1)
    return (((rest >> bits) + cost) << bits) + ((letter << (bits - DIGIT)) if width else 0) + (low >> DIGIT)


def _least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def _inserted(base: list[int | None], width: int) -> list[int | None]:
    """Weights with insertions in front: at most two are of use, a third one would lead back."""
    now = base
    for _ in range(2):
        now = [_least(base[s], _edge(INSERT, COST[INSERT], now[NEXT[s]], width)) for s in range(4)]
    return now


def weights(faults: str, initials: str, after: list[int | None], last: bool, width: int) -> list[int | None]:
    """The weight of the best path from each state before the lines to states that cost ``after`` behind them.

    ``faults`` has b (blank), d (duplicate), t (truncated) or n for each line; ``last`` lines may have insertions behind them.
    """
    now = _before(after, width)
    if last:
        now = _inserted(now, width)
    for fault, initial in zip(reversed(faults), reversed(initials)):
        base = []
        for s in range(4):
            best = _edge(DELETE, COST[DELETE], now[s], width)
            if fault in "nt":
                more = CUT_SHORT if fault == "t" else 0
                best = _least(best, _edge(REROLE, COST[REROLE] + more, now[NEXT[s]], width))
                if (s, initial) in STEP:
                    best = _least(best, _edge(KEEP, COST[KEEP] + more, now[STEP[s, initial]], width))
            base.append(best)
        now = _inserted(base, width)
    return now


def letters_of(weight: int, width: int) -> str:
    digits = (weight >> (DIGIT * (width - 1 - k)) & ((1 << DIGIT) - 1) for k in range(width))
    return "".join(LETTERS[d] for d in digits if d)


def walk(state: int, letters: str, initials: str) -> Iterator[tuple[int, int, str]]:
    """(line or -1, state after, letter) of each edit."""
    line = 0
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield -1, state, letter
            continue
        if letter == "K":
            state = STEP[state, initials[line]]
        elif letter == "R":
            state = NEXT[state]
        yield line, state, letter
        line += 1


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of what is left of (conv_id, turn, role, text), by crc32 of ``conv_id:turn``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    draw = F.crc32(key) % 20
    return rows.where(draw != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(draw == 3, 2).otherwise(1).alias("copies"),
    )


_PIECES = ("conv_id long, at long, faults string, initials string, turns array<long>, distinct_turns long, roles array<string>, texts array<string>")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines (conv_id, turn, role, text, copies, first, fault, part) to pieces of one conversation each.

    Only lines that may be kept bring their role and text along.
    """
    rows, count = [], 0
    own: dict | None = None

    def begin(conv):
        return {"conv": conv, "faults": [], "initials": [], "turns": [], "distinct": 0, "roles": [], "texts": [], "bytes": 0, "last": None}

    def done(piece, part):
        nonlocal count
        rows.append((piece["conv"], (part << 33) + count, "".join(piece["faults"]), "".join(piece["initials"]), piece["turns"], piece["distinct"], piece["roles"], piece["texts"]))
        count += 1

    def flush():
        columns = list(zip(*rows))
        rows.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "at", "faults", "initials", "turns", "distinct_turns", "roles", "texts"])

    part, held = 0, 0
    for batch in batches:
        for conv, turn, role, text, copies, first, fault, part in zip(*(c.to_pylist() for c in batch.columns)):
            for copy in range(copies):
                if own is not None and (own["conv"] != conv or len(own["faults"]) >= PIECE or own["bytes"] >= PIECE_BYTES):
                    done(own, part)
                    held += own["bytes"] + 1000
                    own = None
                    if held > PIECE_BYTES:
                        yield flush()
                        held = 0
                if own is None:
                    own = begin(conv)
                kind = fault if fault == "b" else "d" if copy or not first else fault
                own["faults"].append(kind)
                own["initials"].append(role[0] if role[:1] in ("s", "u", "a") else "x")
                if turn is not None and turn != own["last"]:
                    own["distinct"] += 1
                    own["turns"] = [own["turns"][0] if own["turns"] else turn, turn]
                    own["last"] = turn
                alive = kind in "nt"
                own["roles"].append(role if alive else None)
                own["texts"].append(text if alive else None)
                own["bytes"] += len(text) if alive else 0
    if own is not None:
        done(own, part)
    if rows:
        yield flush()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs between the states before and behind a piece, row by row; -1 where no path is."""
    for batch in batches:
        out = []
        for faults, initials in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            columns = [weights(faults, initials, [0 if s == t else None for s in range(4)], False, 0) for t in range(4)]
            out.append([-1 if columns[t][s] is None else columns[t][s] for s in range(4) for t in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "at", "costs"])


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation from the last to the first: what the states behind each one cost."""
    conv, after, some = None, END, False
    for batch in batches:
        out, ends = [], []
        for own, costs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if not some or own != conv:
                conv, after, some = own, END, True
                ends.append(True)
            else:
                ends.append(False)
            out.append(after)
            after = [min((costs[4 * s + t] + after[t] for t in range(4) if costs[4 * s + t] >= 0), default=1 << 60) for s in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(ends)], names=["at", "after", "last"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the cost and the letters of the best edits from each state to every piece."""
    for batch in batches:
        names = batch.schema.names
        get = {k: batch.column(names.index(k)).to_pylist() for k in ("faults", "initials", "after", "last")}
        costs, letters = [], []
        for faults, initials, after, last in zip(get["faults"], get["initials"], get["after"], get["last"]):
            final = last is None or last
            width = 3 * (len(faults) + 1)
            best = weights(faults, initials, [0, None, None, 0] if final else after, final, width)
            costs.append([w >> (DIGIT * width) for w in best])
            letters.append([letters_of(w, width) for w in best])
        kept = [batch.column(i) for i, k in enumerate(names) if k not in ("after", "last")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(costs, pa.list_(pa.int64())), pa.array(letters, pa.list_(pa.string()))],
            names=[*[k for k in names if k not in ("after", "last")], "costs", "letters"])


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of a conversation after some of its pieces."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit, self.sha, self.lines = conv, START, None, [], hashlib.sha256(), 0
        self.counts, self.illegal, self.initial = {"b": 0, "d": 0, "t": 0, "n": 0}, 0, None
        self.low = self.high = None
        self.distinct = 0

    def add(self, faults, initials, turns, distinct, roles, texts, costs, letters):
        for k in self.counts:
            self.counts[k] += faults.count(k)
        chain = (self.initial or "") + initials
        self.illegal += sum(chain[i : i + 2] not in _LEGAL for i in range(len(chain) - 1))
        self.initial = initials[-1]
        if turns:
            self.distinct += distinct - (turns[0] == self.high)
            self.low = turns[0] if self.low is None else self.low
            self.high = turns[-1]
        if self.cost is None:
            self.cost = costs[self.state]
        own = letters[self.state]
        self.audit.append(own)
        for line, state, letter in walk(self.state, own, initials):
            self.state = state
            if letter == "D":
                continue
            role = roles[line] if letter == "K" else "user" if state == USER else "assistant"
            text = "" if letter == "I" else texts[line]
            self.sha.update((("\n" if self.lines else "") + role + ":" + text).encode())
            self.lines += 1

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        c = self.counts
        return self.conv, gaps, c["b"], c["d"], c["t"], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row for each conversation; texts pass through the digest piece by piece."""
    own = None
    names = [c.split()[0] for c in _REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            conv, _, *piece = (c[i].as_py() for c in batch.columns)
            if own is None or own.conv != conv:
                if own is not None:
                    rows.append(own.row())
                own = _Conversation(conv)
            own.add(*piece)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(own.row(), kinds)], names=names)


def pieces(lines: DataFrame) -> DataFrame:
    """Pieces of the conversations in (conv_id, turn, role, text, copies), in order of turn, role and digest of the text.

    Equal lines are counted before they are shuffled. A line is a duplicate if its role and text occur at an earlier turn, or
    before it at the same one. Range partitions cut long conversations; ``at`` orders the pieces of a conversation.
    """
    counted = lines.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256))
    counted = written(counted, "lines")
    firsts = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("n")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    ranged = (
        same(counted, firsts, ["conv_id", "role", "digest"])
        .withColumns({"is_first": F.col("turn").eqNullSafe(F.col("first.turn")), "fault": fault})
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "text", "copies", "is_first", "fault", F.spark_partition_id().cast("long").alias("part"))
    )
    out = written(ranged.mapInArrow(_cut, _PIECES), "pieces")
    drop_written(counted)
    return out


def repair(rows: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text): faults, and the cheapest edits that repair it.

    ``lines`` (conv_id, turn, role, text, copies) are what is left of them, or else ``damaged(rows)``. A repaired
    conversation has the role initials ``(s?(ua)+)?``. Keeping a line costs 0, changing its role to user or assistant 1,
    deleting it 2, inserting an empty line 5; a truncated line that isn't deleted costs 5 more; blank and duplicate lines
    must go. Of the cheapest edits ``audit`` has the first in ASCII order.

    Defined cases: null role, text, and null ids inside the damage key count as one blank, a role that begins neither with
    s, u nor a cannot be kept; null turns come first and count for no gap; rows of the same turn come by role, then by the
    digest of their text; a null conv_id is a conversation of its own; repeated rows are duplicates; a conversation without
    lines has zeros, an empty audit and the digest of nothing; an empty table gives no rows; other columns are not read.
    """
    table = pieces(damaged(rows) if lines is None else lines)
    several = table.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    light = same(table.select("conv_id", "at", "faults", "initials"), several, ["conv_id"], "left_semi")
    costs = written(light.mapInArrow(_matrices, "conv_id long, at long, costs array<long>"), "costs")
    after = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(_backwards, "at long, after array<long>, last boolean")
    after = written(after, "after")
    solved = table.join(after, "at", "left").select(*table.columns, "after", "last").mapInArrow(
        _solved, _PIECES + ", costs array<long>, letters array<string>")
    reports = solved.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_reports, _REPORT)
    every = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.lit(1).alias("there")).drop("there")
    joined = same(every, reports, ["conv_id"], "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    out = written(joined.select("conv_id", *[_or(c, empty.get(c, 0)) for c in joined.columns if c != "conv_id"]), "repairs")
    drop_written(table, costs, after)
    return out


def _or(column: str, value) -> Column:
    return F.coalesce(F.col(column), F.lit(value)).alias(column)
