"""Repair of conversations by a generalised LR parse of their roles.

The roles of a conversation have to follow a grammar: perhaps a system turn, then pairs of user and
assistant, or nothing at all. The LR(0) automaton is built from the rules. All stacks that a prefix
of the turns can lead to are kept side by side in a graph whose vertices are (state, vertex below),
so equal stacks are one vertex; each holds the least (cost, audit) that leads to it. A turn is kept,
given another role, or deleted, and missing turns are inserted; the audit is the string of the
edits' initials. Two ways over the same turns to the same vertex that cost the same never have
audits of which one begins the other (only insertions could follow, and they cost), so the least of
both stays the least whatever comes after.

For the same reason the parse can be cut: a block of turns is summed up by its best way from every
stack to every stack. Turns are sorted by range, not by conversation, so a conversation may lie in
any number of partitions; each partition cuts it into blocks of bounded size. A conversation that is
one block inside a partition is decided there. The blocks of others are put together in order by a
second pass, which carries one best way per stack and hands out decisions as soon as all of them
agree. Equal turns of a conversation travel as one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsight.operators.lookups import match
from flowsight.session import materialize

#: Rules of the role grammar, the start symbol's first.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits and of a truncated turn that stays, blanks, ends of sentences.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS, ENDS = " \t\n\v\f\r", (".", "!", "?")
LEGAL = ("su", "ua", "au")
#: Faults of a turn.
FINE, SURPLUS, CUT = range(3)
#: Rows of a block, and remembered parses of a task.
BLOCK, REMEMBERED = 512, 200_000

Stack = tuple  # of numbers of LR states, the bottom first


def _closure(items: frozenset) -> frozenset:
    todo, out = list(items), set(items)
    while todo:
        rule, dot = todo.pop()
        for n, (head, _) in enumerate(GRAMMAR):
            if GRAMMAR[rule][1][dot : dot + 1] == head and (n, 0) not in out:
                out.add((n, 0))
                todo.append((n, 0))
    return frozenset(out)


@cache
def automaton() -> tuple[list[frozenset], dict[tuple[int, str], int]]:
    """The LR(0) states as sets of (rule, place of the dot), and the steps between their numbers."""
    symbols = sorted({c for _, body in GRAMMAR for c in body})
    states = [_closure(frozenset((n, 0) for n, (head, _) in enumerate(GRAMMAR) if head == GRAMMAR[0][0]))]
    steps = {}
    for i, state in enumerate(states):
        for c in symbols:
            items = frozenset((n, dot + 1) for n, dot in state if GRAMMAR[n][1][dot : dot + 1] == c)
            if items:
                reached = _closure(items)
                if reached not in states:
                    states.append(reached)
                steps[i, c] = states.index(reached)
    return states, steps


@cache
def _reduced(stack: Stack) -> tuple[Stack, ...]:
    """The stacks that reductions make of one, itself included; an accepted conversation's is empty."""
    states, steps = automaton()
    out = [stack]
    for top in out:
        for n, dot in sorted(states[top[-1]]) if top else ():
            head, body = GRAMMAR[n]
            if dot == len(body):
                below = top[: len(top) - dot]
                if below == (0,) and head == GRAMMAR[0][0]:
                    out.append(())
                elif (below[-1], head) in steps and (made := (*below, steps[below[-1], head])) not in out:
                    out.append(made)
    return tuple(out)


@cache
def advance(stack: Stack, symbol: str) -> tuple[Stack, ...]:
    """The stacks after one more role."""
    steps = automaton()[1]
    return tuple((*s, steps[s[-1], symbol]) for s in _reduced(stack) if s and (s[-1], symbol) in steps)


@cache
def accepts(stack: Stack) -> bool:
    return () in _reduced(stack)


@cache
def stacks() -> tuple[Stack, ...]:
    """All stacks between two turns; the empty conversation's comes first."""
    out = [(0,)]
    for stack in out:
        for symbol in sorted({c for _, body in GRAMMAR for c in body if c.islower()}):
            out.extend(s for s in advance(stack, symbol) if s not in out)
    return tuple(out)


def _offer(ways: dict, stack: Stack, cost: int, audit: str) -> bool:
    if stack in ways and ways[stack] <= (cost, audit):
        return False
    ways[stack] = (cost, audit)
    return True


def _with_inserts(ways: dict) -> dict:
    todo = list(ways)
    while todo:
        stack = todo.pop()
        cost, audit = ways[stack]
        for symbol in ROLES:
            todo.extend(s for s in advance(stack, symbol) if _offer(ways, s, cost + INSERT, audit + "I"))
    return ways


def parse(codes: list[tuple[str, int]], entry: Stack, first: bool) -> dict[Stack, tuple[int, str]]:
    """The best (cost, audit) over some turns from one stack to each stack.

    A turn is (initial of its role, fault). Insertions come after a turn, and before the ``first``.
    """
    ways = {entry: (0, "")}
    if first:
        _with_inserts(ways)
    for initial, fault in codes:
        new: dict = {}
        extra = TRUNCATED if fault == CUT else 0
        for stack, (cost, audit) in ways.items():
            _offer(new, stack, cost + DELETE, audit + "D")
            if fault != SURPLUS:
                for s in advance(stack, initial):
                    _offer(new, s, cost + extra, audit + "K")
                for symbol in ROLES:
                    for s in advance(stack, symbol):
                        _offer(new, s, cost + REROLE + extra, audit + "R")
        ways = _with_inserts(new)
    return ways


def best(ways: dict) -> tuple[int, str]:
    return min(w for s, w in ways.items() if accepts(s))


def replay(audit: str, initials: list[str], entry: Stack) -> Iterator[tuple[int, str | None]]:
    """The turns that the edits leave, as (number of the row or -1, new role or None)."""
    stack, at = entry, 0
    for edit in audit:
        if edit in "KR" or edit == "I":
            symbol = initials[at] if edit == "K" else next(s for s in ROLES if advance(stack, s))
            yield (-1 if edit == "I" else at), (None if edit == "K" else ROLES[symbol])
            (stack,) = advance(stack, symbol)
        at += edit != "I"


def expanded(audit: str, copies: list[int]) -> str:
    """The edits with the deletions of surplus copies, which follow their row at once."""
    if max(copies, default=1) == 1:
        return audit
    left = iter(copies)
    return "".join(e if e == "I" else e + "D" * (next(left) - 1) for e in audit)


BLOCK_SCHEMA = """conv_id {key}, part int, block int, whole boolean, turns array<long>, roles array<string>, texts array<string>,
    copies array<long>, initials array<string>, blank long, duplicate long, truncated long, illegal long, n_turns long, lowest long, highest long,
    entries array<int>, exits array<int>, costs array<long>, audits array<string>"""


class _Blocks:
    """Cuts the sorted rows of a partition into blocks."""

    def __init__(self, part: int) -> None:
        self.part, self.memory, self.out = part, {}, []
        self.key, self.rows, self.number, self.edge = None, [], 0, True

    def add(self, row: tuple) -> None:
        if self.rows and row[0] != self.key:
            self.cut(last=True, edge=self.edge)
            self.number, self.edge = 0, False
        elif len(self.rows) == BLOCK:
            self.cut(last=False, edge=self.edge)
            self.number += 1
        self.key = row[0]
        self.rows.append(row)

    def cut(self, last: bool, edge: bool) -> None:
        _, turns, roles, texts, copies, initials, blank, cut, seen = (list(c) for c in zip(*self.rows, strict=True))
        codes, counts = [], [0, 0, 0]
        for n, b, c, s in zip(copies, blank, cut, seen, strict=True):
            codes.append(SURPLUS if b or s else CUT if c else FINE)
            if b:
                counts[0] += n
            else:
                counts[1] += n - (not s)
                counts[2] += not s and c
        whole = last and not edge and not self.number
        known = (tuple(initials), tuple(codes)) if whole else None
        if whole:
            if known not in self.memory:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[known] = best(parse(list(zip(initials, codes, strict=True)), stacks()[0], True))
            ways = {(0, 0): self.memory[known]}
        else:
            ways = {
                (i, stacks().index(s)): w
                for i, entry in enumerate(stacks())
                for s, w in parse(list(zip(initials, codes, strict=True)), entry, False).items()
            }
        again = sum(copies) - len(copies)  # copies of a row in its own place: deleted, whatever the way
        present = [t for t in turns if t is not None]
        self.out.append(
            (self.key, self.part, self.number, whole, turns, roles, texts, copies, initials, *counts,
             again + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
             len(set(present)), min(present, default=None), max(present, default=None),
             *(list(c) for c in zip(*((i, j, c + DELETE * again, a) for (i, j), (c, a) in ways.items()), strict=True)))
        )
        self.rows = []


def _batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), like, strict=True)], schema=like)


def _cut_blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for part, *row in zip(*columns, strict=True):
                blocks = blocks or _Blocks(part)
                blocks.add(tuple(row))
            if blocks and blocks.out:
                yield _batch(blocks.out, schema)
                blocks.out = []
        if blocks:
            blocks.cut(last=True, edge=True)
            yield _batch(blocks.out, schema)

    return run


JOINED_SCHEMA = """conv_id {key}, part int, block int, entry int, slice string, blank long, duplicate long, truncated long, illegal long,
    gaps long, cost long, audit string"""
NOTHING = (None,) * 7


class _Joined:
    """Puts the blocks of one conversation together: decided slices, and at the end its result."""

    def __init__(self, key: object) -> None:
        self.key, self.out, self.audit = key, [], []
        # per stack: cost, undecided edits, and the undecided blocks with their entry and slice
        self.ways = {stacks().index(s): (c, a, ()) for s, (c, a) in _with_inserts({stacks()[0]: (0, "")}).items()}
        self.opened = {i: a for i, (_, a, _) in self.ways.items()}
        self.counts, self.n_turns, self.lowest, self.highest = [0] * 4, 0, None, None
        self.last_turn, self.last_initial, self.copies, self.cut = None, None, {}, 0

    def add(self, b: dict) -> None:
        for i, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += b[c]
        if self.last_initial is not None and self.last_initial + b["initials"][0] not in LEGAL:
            self.counts[3] += 1
        self.last_initial = b["initials"][-1]
        if b["n_turns"]:
            self.n_turns += b["n_turns"] - (self.last_turn is not None and self.last_turn == b["lowest"])
            self.lowest = b["lowest"] if self.lowest is None else self.lowest
            self.highest = self.last_turn = b["highest"]
        self.copies[b["part"], b["block"]] = b["copies"]
        new: dict = {}
        for i, j, cost, audit in zip(b["entries"], b["exits"], b["costs"], b["audits"], strict=True):
            if i in self.ways:
                c, a, path = self.ways[i]
                way = (c + cost, a + audit, (*path, (b["part"], b["block"], i, audit)))
                if j not in new or way[:2] < new[j][:2]:
                    new[j] = way
        self.ways = new
        self.decide()

    def decide(self) -> None:
        """Hands out the blocks that all ways agree on."""
        paths = [w[2] for w in self.ways.values()]
        n = 0
        while n < len(paths[0]) - 1 and all(p[n] == paths[0][n] for p in paths):
            n += 1
        if n:
            self.send(next(iter(self.ways.values())), n)
            self.ways = {i: (c, a[self.cut :], p[n:]) for i, (c, a, p) in self.ways.items()}

    def send(self, way: tuple, n: int) -> None:
        self.cut = 0
        for at, (part, block, entry, audit) in enumerate(way[2][:n]):
            if not at and not self.audit:  # the insertions before the first block belong to it
                ahead = len(way[1]) - sum(len(s[3]) for s in way[2])
                audit, entry = way[1][:ahead] + audit, 0
            self.cut += len(audit)
            self.out.append((self.key, part, block, entry, audit, *NOTHING))
            self.audit.append(expanded(audit, self.copies.pop((part, block))))

    def end(self) -> None:
        cost, _, i = min((w[0], w[1], i) for i, w in self.ways.items() if accepts(stacks()[i]))
        self.send(self.ways[i], len(self.ways[i][2]))
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.n_turns
        self.out.append((self.key, None, None, None, None, *self.counts, gaps, cost, "".join(self.audit)))


def _join_blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = None
        for batch in batches:
            for row in batch.to_pylist():
                if joined is None or joined.key != row["conv_id"]:
                    out = joined.out if joined else []
                    if joined:
                        joined.end()
                    joined = _Joined(row["conv_id"])
                    joined.out = out
                joined.add(row)
            if joined and joined.out:
                yield _batch(joined.out, schema)
                joined.out = []
        if joined:
            joined.end()
            yield _batch(joined.out, schema)

    return run


def _left_turns(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                left = replay(b["slice"], b["initials"], stacks()[b["entry"]])
                for i, (at, role) in enumerate(left):
                    own = (None, None, None) if at < 0 else (b["turns"][at], b["roles"][at], b["texts"][at])
                    out.append((b["conv_id"], b["part"], b["block"], i, at >= 0, *own, role))
            if out:
                yield _batch(out, schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their faults and edits, and the turns that are left of them.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are not read. Turns of a
    conversation are ordered by number, null first, then by role and by the text's SHA-256. The
    first table has a row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit. The second has the repaired turns: conv_id, part, block, place (in this order),
    role, text.

    A null role or text is one space; a null ``conv_id`` is a conversation like any other. A role
    without the initial of a known one can't be kept, an empty one neither. Blank and repeated turns
    are always deleted. An empty table gives empty tables; texts of any length are only hashed and
    carried.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256)), "turns")
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select(
        "conv_id", "turn", "role", "hash", "copies",
        F.substring("role", 1, 1).alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(*ENDS)).alias("cut"),
        # null first: a turn without number comes before all others
        F.struct(F.col("turn").isNotNull().alias("numbered"), "turn").alias("order"),
    )
    first = slim.groupBy("conv_id", "role", "hash").agg(F.min("order").alias("first"))
    slim = match(slim, first, ["conv_id", "role", "hash"]).withColumn("seen", F.col("order") != F.col("first"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "hash"]
    slim = slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
    slim = slim.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "hash", "copies", "initial", "blank", "cut", "seen")
    block_schema, joined_schema = BLOCK_SCHEMA.format(key=kind), JOINED_SCHEMA.format(key=kind)
    blocks = materialize(slim.mapInArrow(_cut_blocks(_arrow(block_schema)), block_schema), "blocks")
    split = blocks.filter(~F.col("whole")).drop("turns", "roles", "texts")
    split = split.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    joined = materialize(split.mapInArrow(_join_blocks(_arrow(joined_schema)), joined_schema), "joined")
    whole = blocks.filter("whole").select(
        "conv_id", "part", "block", "turns", "roles", "texts", "copies", "initials", F.lit(0).alias("entry"),
        F.element_at("audits", 1).alias("slice"), F.element_at("costs", 1).alias("cost"),
        "blank", "duplicate", "truncated", "illegal",
        F.coalesce(F.col("highest") - F.col("lowest") + 1 - F.col("n_turns"), F.lit(0)).cast("long").alias("gaps"),
    )
    results = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    conversations = whole.withColumn("audit", _expanded(F.col("slice"), F.col("copies"))).select(*results)
    conversations = conversations.unionByName(joined.filter(F.col("cost").isNotNull()).select(*results))
    columns = ["conv_id", "part", "block", "turns", "roles", "texts", "initials", "entry", "slice"]
    slices = joined.filter(F.col("slice").isNotNull()).select("conv_id", "part", "block", "entry", "slice")
    decided = match(blocks.filter(~F.col("whole")), slices, ["conv_id", "part", "block"])
    decided = whole.select(*columns).unionByName(decided.select(*columns))
    left_schema = f"conv_id {kind}, part int, block int, place int, old boolean, turn long, role string, hash string, new_role string"
    left = materialize(decided.mapInArrow(_left_turns(_arrow(left_schema)), left_schema), "left")
    texts = rows.select("conv_id", "turn", "role", "hash", "text")
    old = match(left.filter("old"), texts, ["conv_id", "turn", "role", "hash"])
    added = left.filter(~F.col("old")).withColumn("text", F.lit(""))
    turns = old.unionByName(added, allowMissingColumns=True)
    return conversations, turns.select("conv_id", "part", "block", "place", F.coalesce("new_role", "role").alias("role"), "text")


def _expanded(audit: Column, copies: Column) -> Column:
    """``expanded`` as a column: edits with the deletions of surplus copies."""
    step = lambda s, e: F.when(
        e == "I", F.struct(s["at"].alias("at"), F.concat(s["out"], e).alias("out"))
    ).otherwise(
        F.struct(
            (s["at"] + 1).alias("at"),
            F.concat(s["out"], e, F.repeat(F.lit("D"), (F.element_at(copies, s["at"] + 1) - 1).cast("int"))).alias("out"),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.array_max(copies) == 1, audit).otherwise(F.aggregate(F.split(audit, ""), start, step, lambda s: s["out"]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which arrive in order; only one state is held."""
    key, state, begun = None, None, False
    keys, out = [], []
    for batch in batches:
        for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if not begun or k != key:
                if begun:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state, begun = k, hashlib.sha256(), True
            else:
                state.update(b"\n")
            state.update(role.encode() + b":" + text.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("conv_id").type), pa.array(out)], names=["conv_id", "digest"])
            keys, out = [], []
        kind = batch.schema.field("conv_id").type
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], names=["conv_id", "digest"])


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, the SHA-256 of its turns as lines ``role:text``; ``turns`` is from ``repair``.

    The digest is of all lines in order, so a conversation's lines pass through one task, which holds
    a batch of them and the state of the hash. Conversations without turns have no row.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "place")
    return ordered.mapInArrow(_hashed, f"conv_id {kind}, digest string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats the row, 4 makes it a
    user's. Nulls count as one space, in the checksum and in role and text; numbers stay null.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(spaced("text"), "".join(ENDS), ""))
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("_fault")).filter(F.col("_fault") != 0)
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(spaced("role")).alias("role"),
        text.otherwise(spaced("text")).alias("text"),
    )
