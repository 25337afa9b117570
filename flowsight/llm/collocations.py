"""Collocations of two and three words by best-first growth of prefixes.

A phrase scores ``1000000 * a * a / (l * r)`` at its weakest cut, where ``a`` counts the phrase and
``l`` and ``r`` the two sides. As ``a`` is at most ``r``, no phrase that begins with the words x y can
score above ``1000000 * f(x y) / f(x)``: the counts of a prefix bound all that grows from it.

Words are counted first, then pairs of words that are frequent themselves; those pairs are scored and
stand as prefixes in the frontier. Rounds expand the prefixes of highest bound, per language down to
a cut: they count the triples that begin with an expanded prefix, and those that end with a pair
that itself scores at least the cut (they decide whether the pair is dropped; as a pair's own bound
is no lower than its score, the triples that begin with it are counted anyway). After a round, all
phrases that score at least the cut are known, kept or dropped. A language is settled when
``limit`` of them are kept, or when its cut is 0; else its cut falls and the frontier grows.

Every count reads the texts again, which is cheaper than shuffling them: tasks get bitmaps of fixed
size that tell frequent words, pairs and expanded prefixes, and send counts alone. Wrong hits in a
bitmap cost rows, not results, as exact counts are compared again. Words are told apart by 64-bit
hashes of language and word, phrases by the hashes of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsight.llm.common import small_batches
from flowsight.llm.hashing import KEEP, MIX, ODD, mixed
from flowsight.session import materialize

#: Characters of the texts that a task takes at a time; a longer text is taken alone.
CHARS = 4_000_000
#: Rows that a task adds up before it sends them on.
PENDING = 2_000_000
#: Bits of a bitmap: 8 MB.
BITS = 26
#: Bounds are cut at multiples of this many millionths.
STEP = 1000
#: Prefixes per wanted phrase in the first round, and how many times as many in each further one.
FIRST, GROWTH = 4, 8
#: What separates words and pieces, and the language of rows without one.
BLANKS, BREAKS, NO_LANG = b" \t", b".,;:!?\n\v\f\r", "und"

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KIND = np.array([2 if b in BREAKS else 1 if b in BLANKS else 0 for b in range(256)], dtype=np.uint8)


class Words:
    """The words of some texts, one after the other: hash with the language, piece, and place."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        joined = b"\n".join([*texts, bytes(8)]).translate(LOWER)
        data = np.frombuffer(joined, dtype=np.uint8)
        kind = KIND[data]
        kind[-8:] = 2
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.data, self.langs = joined, langs
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(begins, self.start, side="right") - 1
        seeds = {lang: _hashes(lang.encode() + bytes(8), np.array([0]), np.array([len(lang.encode())]))[0] for lang in set(langs)}
        with np.errstate(over="ignore"):
            self.hash = _hashes(joined, self.start, self.end)
            self.hash = mixed(self.hash ^ np.array([seeds[lang] for lang in langs], dtype=np.uint64)[self.text] * ODD)

    def runs(self, n: int) -> np.ndarray:
        """Places where ``n`` words stand in one piece."""
        last = len(self.hash) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, dtype=np.int64)


def _hashes(joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices; eight bytes at least follow the last one."""
    eights = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        out = mixed(size.astype(np.uint64) + ODD) * ODD
        done, at = 0, np.arange(len(start))
        while len(at):
            out[at] = mixed(out[at] * ODD ^ (eights[start[at] + done] & KEEP[np.minimum(size[at] - done, 8)]))
            done += 8
            at = at[size[at] > done]
    return out


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first * ODD + mixed(second ^ MIX[0]))


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << BITS) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of as many neighbouring texts as make up ``CHARS``."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if size and size + len(text) > CHARS:
                yield Words(texts, langs)
                texts, langs, size = [], [], 0
            texts.append(text.encode())
            langs.append(lang)
            size += len(text)
    if texts:
        yield Words(texts, langs)


def _added(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one, with the sum of their counts."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(new)
    return [c[head] for c in columns], np.add.reduceat(counts[order], head) if len(head) else counts[:0]


def tallied(found: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of columns, added up within the task as far as ``PENDING`` rows hold them."""

    def sent(columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns] + [pa.array(counts)], names=[*names, "a"])

    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    rows = 0
    for columns in found:
        held.append(_added(columns, np.ones(len(columns[0]), dtype=np.int64)))
        rows += len(held[-1][1])
        if rows > PENDING:
            columns, counts = _added([np.concatenate(c) for c in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]))
            held, rows = [(columns, counts)], len(counts)
            if rows > PENDING // 2:
                yield sent(columns, counts)
                held, rows = [], 0
    if held:
        yield sent(*_added([np.concatenate(c) for c in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held])))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of some texts, with their counts."""
    for words in gathered(batches):
        hashes, first, counts = np.unique(words.hash, return_index=True, return_counts=True)
        spans = zip(words.start[first], words.end[first], strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words.langs[t] for t in words.text[first]], pa.string()),
                pa.array([words.data[a:b].decode() for a, b in spans], pa.string()),
                pa.array(hashes.view(np.int64)),
                pa.array(counts.astype(np.int64)),
            ],
            names=["lang", "word", "h", "a"],
        )


def _pairs(batches: Iterator[pa.RecordBatch], common: Broadcast) -> Iterator[pa.RecordBatch]:
    """Pairs of frequent words."""

    def found() -> Iterator[list[np.ndarray]]:
        for words in gathered(batches):
            at, known = words.runs(2), marked(common.value, words.hash)
            at = at[known[at] & known[at + 1]]
            yield [words.hash[at], words.hash[at + 1]]

    return tallied(found(), ["h1", "h2"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the hash that stands for them in bitmaps."""
    for batch in batches:
        h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        yield batch.append_column("pair", pa.array(pair_hash(h1, h2).view(np.int64)))


def _triples(batches: Iterator[pa.RecordBatch], pairs: Broadcast, grown: Broadcast, wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """Triples of two frequent pairs that begin with a grown prefix or end with a wanted pair."""

    def found() -> Iterator[list[np.ndarray]]:
        for words in gathered(batches):
            h, at = words.hash, words.runs(3)
            left, right = pair_hash(h[at], h[at + 1]), pair_hash(h[at + 1], h[at + 2])
            here = marked(grown.value, left) | marked(wanted.value, right)
            here &= marked(pairs.value, left) & marked(pairs.value, right)
            at = at[here]
            yield [h[at], h[at + 1], h[at + 2]]

    return tallied(found(), ["h1", "h2", "h3"])


def bitmap(rows: DataFrame, column: str) -> Broadcast:
    """``BITS`` bits that tell which hashes are there; the driver gets 2**(BITS - 6) rows at most."""
    at = F.col(column).bitwiseAND((1 << BITS) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    found = rows.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(out)


def counted(texts: DataFrame, scan: Callable, keys: list[str], least: int) -> DataFrame:
    """What ``scan`` sends from the texts, added up per key; rows counted less often go."""
    schema = ", ".join(f"{k} long" for k in [*keys, "a"])
    sums = texts.mapInArrow(scan, schema).groupBy(*keys).agg(F.sum("a").alias("a"))
    return sums.filter(F.col("a") >= least)


def share(a: Column, parts: list[Column]) -> Column:
    """``1000000 * a ** len(parts)`` over the product of the parts, rounded down; exact."""
    wide = [c.cast("decimal(15,0)") for c in (*[a] * len(parts), *parts)]
    above, below = F.lit(1_000_000).cast("decimal(7,0)"), F.lit(1).cast("decimal(1,0)")
    for c in wide[: len(parts)]:
        above = above * c
    for c in wide[len(parts) :]:
        below = below * c
    return F.call_function("div", above, below)


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs with the counts of their words, their score and the bound of what they begin."""
    one = words.select(F.col("h").alias("h1"), "lang", F.col("a").alias("a1"))
    two = words.select(F.col("h").alias("h2"), F.col("a").alias("a2"))
    out = pairs.join(one, "h1").join(two, "h2")
    a, l, r = F.col("a"), F.col("a1"), F.col("a2")
    return out.select("lang", "h1", "h2", "pair", "a", "a1", "a2", share(a, [l, r]).alias("score"), share(a, [l]).alias("bound"))


def scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples at their weakest cut, the first one of equals."""
    left = pairs.select("h1", "h2", "lang", F.col("a1").alias("l1"), F.col("a").alias("l2"))
    right = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("r1"), F.col("a2").alias("r2"))
    out = triples.join(left, ["h1", "h2"]).join(right, ["h2", "h3"])
    a = F.col("a")
    out = out.withColumn("s1", share(a, [F.col("l1"), F.col("r1")])).withColumn("s2", share(a, [F.col("l2"), F.col("r2")]))
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return out.select("lang", "h1", "h2", "h3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))


def cuts_at(pairs: DataFrame, prefixes: int) -> DataFrame:
    """Per language, the highest multiple of ``STEP`` that so many prefixes reach; 0 if fewer do."""
    levels = pairs.groupBy("lang", (F.floor(F.col("bound") / STEP) * STEP).cast("long").alias("level")).agg(F.count("*").alias("n"))
    from_above = W.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = F.sum("n").over(from_above) >= prefixes
    levels = levels.select("lang", F.when(reached, F.col("level")).otherwise(0).alias("level"))
    return levels.groupBy("lang").agg(F.max("level").alias("cut"))


def survivors(pairs: DataFrame, triples: DataFrame, cuts: DataFrame, cover: int) -> DataFrame:
    """Phrases that score at least their language's cut and that no longer candidate covers.

    A triple covers a pair inside it if it is found ``cover`` percent as often or more.
    """
    inside = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    inside = inside.groupBy("h1", "h2").agg(F.max("a").alias("covered"))
    high = lambda df: df.join(cuts, "lang").filter(F.col("score") >= F.col("cut"))
    two = high(pairs).join(inside, ["h1", "h2"], "left")
    two = two.filter(F.coalesce(100 * F.col("covered") < cover * F.col("a"), F.lit(True)))
    columns = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
    two = two.select("lang", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", F.col("a1").alias("l"), F.col("a2").alias("r"), "score")
    return two.unionByName(high(triples).select(*columns))


def mine(docs: DataFrame, limit: int = 2000, least: int = 10, cover: int = 50) -> DataFrame:
    """The best ``limit`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are split into pieces at ``.,;:!?`` and U+000A to U+000D, pieces into words at spaces and
    tabs; A-Z count as a-z. Candidates are phrases of two or three words of one piece found ``least``
    times or more. Rows are ranked by score, count (both falling) and the phrase's bytes.

    A null text holds no words, a null language is ``und``; empty texts, empty tables and languages
    without candidates give no rows. Repeated rows count each time. Texts of any length are read
    whole. Only the columns ``lang`` and ``text`` are read, so others may have any name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = texts.mapInArrow(_words, "lang string, word string, h long, a long")
    words = materialize(words.groupBy("lang", "word", "h").agg(F.sum("a").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    words = words.filter(F.col("a") >= least)
    common = bitmap(words, "h")
    pairs = counted(texts, partial(_pairs, common=common), ["h1", "h2"], least)
    pairs = pairs.mapInArrow(_hashed, "h1 long, h2 long, a long, pair long")
    pairs = materialize(scored_pairs(pairs, words), "pairs")
    frequent = bitmap(pairs, "pair")
    prefixes = FIRST * limit
    cuts = cuts_at(pairs, prefixes)
    while True:
        cuts = materialize(cuts, "cuts")
        reach = pairs.join(cuts, "lang")
        grown, wanted = (bitmap(reach.filter(F.col(c) >= F.col("cut")), "pair") for c in ("bound", "score"))
        triples = counted(texts, partial(_triples, pairs=frequent, grown=grown, wanted=wanted), ["h1", "h2", "h3"], least)
        triples = materialize(scored_triples(triples, pairs), "triples")
        kept = survivors(pairs, triples, cuts, cover)
        found = kept.groupBy("lang").agg(F.count("*").alias("found"))
        cuts = cuts.join(found, "lang", "left").withColumn("open", (F.col("cut") > 0) & (F.coalesce("found", F.lit(0)) < limit))
        if not cuts.filter("open").limit(1).count():
            break
        prefixes *= GROWTH
        lower = cuts_at(pairs, prefixes).withColumnRenamed("cut", "lower")
        cuts = cuts.join(lower, "lang").select("lang", F.when(F.col("open"), F.col("lower")).otherwise(F.col("cut")).alias("cut"))
    for i in (1, 2, 3):
        named = words.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"))
        kept = kept.join(named, f"h{i}", "left" if i == 3 else "inner")
    kept = kept.join(totals, "lang").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
