"""Token counts of a piece-BPE vocabulary by rank-synchronous merging of ragged arrays.

A text is cut where no piece of the vocabulary can lie across: before a run of word marks, and around
line ends if the vocabulary has none. The distinct units of a batch become one flat array of symbols
with a border per unit. In each round every unit merges its pair of best score, the leftmost of
equals, all units at once; a unit without a pair is done. What survives is counted, characters that
the vocabulary lacks by their UTF-8 bytes. Each distinct unit is merged once per worker.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowsight.llm.common import text_chunks, worker_cache

MARK = "▁"
#: Units of more symbols go through a heap: rounds over arrays would take quadratic time there.
LONG_UNIT = 256
CACHE_UNITS = 400_000
NONE = np.iinfo(np.int64).max


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


def read_model(path: str) -> dict:
    """Pieces that merging may build with their scores, and the model's settings.

    Only BPE models with byte fallback, an unchanged (identity) text and word marks are supported;
    others raise ValueError. Fixed values: the field numbers and kinds of the model format.
    """
    normal, unused, user, trainer, normalizer = {}, 4, 4, {}, {}
    with open(path, "rb") as f:
        content = f.read()
    for field, value in _fields(content):
        if field == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, 1)
            if kind in (unused, 5):
                raise ValueError("unused or user-defined pieces are not supported")
            if kind == 1:
                normal[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1):
        raise ValueError("only byte-fallback BPE models without normalisation are supported")
    return {"scores": normal, "prefix": bool(normalizer.get(3, 1))}


class Merger:
    def __init__(self, model: dict) -> None:
        scores = model["scores"]
        self.prefix = MARK if model["prefix"] else ""
        crossing = any(a != MARK and b == MARK for p in scores for a, b in zip(p, p[1:], strict=False))
        if crossing:
            raise ValueError("a piece reaches over a word mark")
        lines = not any("\n" in p for p in scores)
        self.unit = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        names = dict.fromkeys([*scores, *sorted({c for p in scores for c in p})])
        self.symbol = {p: i for i, p in enumerate(names)}
        self.names = list(names)
        self.single = {p for p in scores if len(p) == 1}
        # scores as ranks: equal scores share one
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank_of = {p: order[s] for p, s in scores.items()}
        pairs = [
            (self.symbol[p[:i]] << 32 | self.symbol[p[i:]], self.rank_of[p] << 32 | self.symbol[p])
            for p in scores
            for i in range(1, len(p))
            if p[:i] in self.symbol and p[i:] in self.symbol
        ]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [NONE], dtype=np.int64)
        self.made = np.array([m for _, m in pairs] + [NONE], dtype=np.int64)
        self.unknown = len(names)
        self.counts: dict[str, int] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged symbol of each pair in one number; NONE if the pair doesn't merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def cost(self, char: str) -> int:
        return 1 if char in self.single else len(char.encode())

    def heap_count(self, unit: str) -> int:
        """One unit's tokens by a heap of pairs over a linked list."""
        n = len(unit)
        parts: list[str | None] = list(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank_of
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(unit[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one side has changed since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return sum(self.cost(p) if len(p) == 1 else 1 for p in parts if p is not None)

    def merge_units(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit, all units side by side."""
        result = np.zeros(len(units), dtype=np.int64)
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        chars = "".join(units)
        distinct = sorted(set(chars))
        of_point = np.zeros(max(map(ord, distinct), default=0) + 1, dtype=np.int64)
        extra = np.zeros(len(of_point), dtype=np.int64)  # tokens beyond one if the character stays alone
        for c in distinct:
            of_point[ord(c)] = self.symbol.get(c, self.unknown)
            extra[ord(c)] = self.cost(c) - 1
        points = np.frombuffer(chars.encode("utf-32-le"), dtype=np.uint32)
        symbols, owner = of_point[points], np.repeat(np.arange(len(units)), sizes)
        spare = extra[points]
        best = self._pairs(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(best >> 32, first)
            done = lowest == NONE >> 32
            length = np.diff(np.r_[first, len(symbols)])
            if done.any():
                ended = np.repeat(done, length)
                result += np.bincount(owner[ended], weights=1 + spare[ended], minlength=len(units)).astype(np.int64)
                symbols, owner, spare, best = (x[~ended] for x in (symbols, owner, spare, best))
                continue
            hit = np.flatnonzero((best >> 32) == np.repeat(lowest, length))
            hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]]  # the leftmost of each unit
            symbols[hit] = best[hit] & 0xFFFFFFFF
            spare[hit] = 0
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, owner, spare, best = (x[keep] for x in (symbols, owner, spare, best))
            at = hit - np.arange(len(hit))
            for changed in (at, at[at > 0] - 1):
                best[changed] = self._pairs(symbols, owner, changed)
        return result

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Best numbers of the pairs that begin at the positions; NONE at the end of a unit."""
        at = np.arange(len(symbols)) if at is None else at
        right = np.minimum(at + 1, len(symbols) - 1)
        found = self.lookup(symbols[at], symbols[right])
        return np.where((right > at) & (owner[at] == owner[right]), found, NONE)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.counts) > CACHE_UNITS:
            self.counts.clear()
        known, split = self.counts, self.unit.findall
        units = [split(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        new = [u for u in dict.fromkeys(x for own in units for x in own) if u not in known]
        short = [u for u in new if len(u) <= LONG_UNIT]
        if short:
            known.update(zip(short, self.merge_units(short).tolist(), strict=True))
        known.update((u, self.heap_count(u)) for u in new if len(u) > LONG_UNIT)
        return [sum(map(known.__getitem__, own)) for own in units]


def _count(batches: Iterator[pa.RecordBatch], model: dict, column: str) -> Iterator[pa.RecordBatch]:
    merger = worker_cache(f"piece_merger_{len(model['scores'])}_{hash(frozenset(model['scores'].items()))}", lambda: Merger(model))
    for batch in batches:
        for rows, texts in text_chunks(batch, column):
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(merger.count(texts), type=pa.int64())],
                names=[*rows.schema.names, "n_tokens"],
            )


def count_tokens(df: DataFrame, model_path: str, column: str = "text") -> DataFrame:
    """Adds ``n_tokens``, the tokens of each text without begin, end or added special tokens.

    A null or empty text has none, an empty table gives an empty one, and a column of that name is
    replaced. Nothing is shuffled and rows are not compared, so repeated rows get equal counts; texts
    of any length are counted whole.
    """
    df = df.drop("n_tokens")
    schema = T.StructType([*df.schema, T.StructField("n_tokens", T.LongType())])
    return df.mapInArrow(partial(_count, model=read_model(model_path), column=column), schema)
