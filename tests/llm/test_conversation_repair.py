"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from flowsight.llm import conversation_repair as cr
from flowsight.llm.queries import QUERIES

BLANKS = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows):
    """Least (cost, audit) by Dijkstra over (rows read, roles so far), and everything else of one conversation."""
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[3])))
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        if not text.strip(BLANKS):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif text.strip(BLANKS)[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def after(state, symbol):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, symbol))

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, left = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            break
        for symbol, role in (("u", "user"), ("a", "assistant")):
            if after(state, symbol):
                heapq.heappush(heap, (cost + 3, audit + "I", at, after(state, symbol), (*left, (role, ""))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, left))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 * (faults[at] == "truncated")
                if after(state, initials[at]):
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, after(state, initials[at]), (*left, rows[at][2:])))
                for symbol, role in (("u", "user"), ("a", "assistant")):
                    if after(state, symbol):
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", at + 1, after(state, symbol), (*left, (role, rows[at][3]))))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest("\n".join(f"{r}:{t}" for r, t in left)))


def expected(rows):
    """Results of all conversations, from damaged rows."""
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    return {key: brute(own) for key, own in by_key.items()}


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "and", "", " \n", None, "ok. ", "é.", "so on", "Fine.\n\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "a"]
    rows = []
    for conv in range(n):
        turn = rng.randint(-2, 3)
        for i in range(rng.randint(1, longest)):
            role = roles[i % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = f"{rng.randint(0, 9999)}." if rng.random() < 0.5 else rng.choice(texts)
            rows.append((conv if conv % 50 else None, turn if rng.random() < 0.95 else None, role, text))
            turn += rng.choice([1, 1, 1, 1, 0, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def found(spark, df):
    repaired, turns = cr.repair(df)
    digests = {r.conv_id: r.digest for r in cr.digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*r[1:], digests.get(r.conv_id, empty)) for r in repaired.collect()}


def spaced(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("block", [512, 3])
def test_equals_search_over_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rows = conversations(block, 300, 14)
    assert found(spark, spark.createDataFrame(rows, SCHEMA)) == expected(spaced(rows))


def test_one_conversation_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"{t}.", "again.", "", "cut"])) for t in range(900)]
    rows += [(8, 1, "tool", f"{i}.") for i in range(300)]
    rows += [(9, 5, "user", "same.")] * 2000 + conversations(5, 20, 6)[:40]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(spark, df) == expected(spaced(rows))


def test_stacks_of_the_grammar():
    assert len(cr.stacks()) == 10
    accepted = {s for s in cr.stacks() if cr.accepts(s)}
    for symbols, good in (("", True), ("s", False), ("ua", True), ("sua", True), ("uaua", True), ("suaua", True), ("u", False), ("sus", None), ("au", None)):
        ways = {cr.stacks()[0]}
        for symbol in symbols:
            ways = {n for s in ways for n in cr.advance(s, symbol)}
        assert (bool(ways & accepted) if ways else None) == good, symbols


def test_awkward_tables(spark):
    repaired, turns = cr.repair(spark.createDataFrame([], SCHEMA))
    assert repaired.collect() == [] and turns.collect() == [] and cr.digests(turns).collect() == []
    rows = [("a", 3, "user", "x" * 1_000_000 + ".", 1, 2), ("a", 4, "assistant", "y.", 1, 2), (None, 0, "user", "hm.", 1, 2)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, part int, audit long")
    assert found(spark, df) == expected([r[:4] for r in rows])


def test_query_equals_search(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = expected(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = QUERIES["op13_conversation_repair"](spark, sf_dir).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r.conv_id: tuple(r[1:]) for r in got} == {k: want.get(k, nothing) for k in {r[0] for r in rows}}


def test_damage(spark):
    rows = conversations(9, 200, 8)
    assert sorted(map(tuple, cr.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == sorted(damage(rows), key=repr)
