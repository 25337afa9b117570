"""Byte-level BPE: pre-tokenisation by scans over codepoint classes, cached pair merging, decoding.

The split of a text into pieces (contractions, words, numbers, symbols and white space, each of the
middle three with one space before it) is a finite automaton. Its symbols are the classes of the
codepoints, refined by a look at the next one to three codepoints. Every symbol is a function from
state to state, functions compose associatively, and so the states of all codepoints of a batch come
from one blocked scan over arrays; no regular expression runs. Each distinct piece is merged once per
worker. Ids and the pieces' byte offsets stay with the row, so ids decode to the exact bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowsight.llm.common import frugal, list_array, ragged, text_chunks

#: Unicode's White_Space property.
WHITE_SPACE = (
    [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
#: What follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# Symbols: letter, number, other, apostrophe of a contraction with one or two letters, white space
# before white space or the end, a space or other white space before something else, text border.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, BREAK, BORDER = range(9)
# States: between pieces, in a word, in a number, in symbols, one or two letters of a contraction
# left, after a space that belongs to the next piece, in white space.
FREE, WORD, DIGITS, SYMBOLS, ONE, TWO, LEAD, WHITE = range(8)

#: Distinct pieces that a task remembers before it forgets half of them.
CACHE_PIECES = 250_000
#: Characters that are encoded at a time; a longer text is encoded alone, at about 60 bytes a character.
ENCODED_CHARS = 500_000


def step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this codepoint."""
    if symbol == LETTER:
        if state in (ONE, TWO):
            return (FREE if state == ONE else ONE), False
        return WORD, state not in (WORD, LEAD)
    if symbol == NUMBER:
        return DIGITS, state not in (DIGITS, LEAD)
    if symbol == OTHER or (symbol in (SHORT, LONG) and state in (SYMBOLS, LEAD)):
        return SYMBOLS, state not in (SYMBOLS, LEAD)
    if symbol in (SHORT, LONG):
        return (ONE if symbol == SHORT else TWO), True
    if symbol == BLANK:
        return WHITE, state != WHITE
    return (LEAD if symbol == SPACE else FREE), True


class Automaton:
    """The transition functions of the symbols, closed under composition, as lookup tables."""

    def __init__(self) -> None:
        states, symbols = range(8), range(9)
        of_symbol = [tuple(step(s, x)[0] for s in states) for x in symbols]
        known = {f: i for i, f in enumerate(dict.fromkeys(of_symbol))}
        queue = list(known)
        while queue:
            f = queue.pop()
            for g in of_symbol:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
        self.starts = np.array([[step(s, x)[1] for x in symbols] for s in states])
        self.function = np.array([known[f] for f in of_symbol], dtype=np.uint8)
        self.apply = np.array(list(known), dtype=np.uint8)
        # first f, then g
        self.compose = np.array([[known[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8)

    def scan(self, functions: np.ndarray, block: int = 64) -> np.ndarray:
        """State after each position, beginning between pieces."""
        n = len(functions)
        if n <= block:
            states, state = np.empty(n, dtype=np.uint8), FREE
            for i, f in enumerate(functions):
                states[i] = state = self.apply[f, state]
            return states
        blocks = -(-n // block)
        padded = np.full(blocks * block, functions[0], dtype=np.uint8)
        padded[:n] = functions
        inside = np.ascontiguousarray(padded.reshape(blocks, block).T)
        for j in range(1, block):
            inside[j] = self.compose[inside[j - 1], inside[j]]
        entry = np.empty(blocks, dtype=np.uint8)
        entry[0] = FREE
        entry[1:] = self.scan(inside[-1])[:-1]
        return self.apply[inside, entry].T.reshape(-1)[:n]

    def boundaries(self, symbols: np.ndarray) -> np.ndarray:
        """Whether a piece starts at each position."""
        before = np.empty(len(symbols), dtype=np.uint8)
        before[:1] = FREE
        before[1:] = self.scan(self.function[symbols])[:-1]
        return self.starts[before, symbols]


def class_table() -> np.ndarray:
    """Letter, number, white space (BLANK) or other for every codepoint; worked out in blocks."""
    import regex

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for start in range(0, len(table), 1 << 13):
        if not 0xD800 <= start < 0xE000:  # surrogates fill such blocks
            block = "".join(map(chr, range(start, start + (1 << 13))))
            for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
                for m in regex.finditer(pattern, block):
                    table[start + m.start() : start + m.end()] = value
    table[WHITE_SPACE] = BLANK
    return table


def symbols_of(points: np.ndarray, borders: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Automaton symbols of concatenated texts; ``borders`` are the positions between texts."""
    symbols = table[points]
    symbols[borders] = BORDER
    solid = np.zeros(len(points), dtype=bool)
    solid[:-1] = (symbols[1:] != BLANK) & (symbols[1:] != BORDER)
    before_solid = (symbols == BLANK) & solid
    symbols[before_solid] = BREAK
    symbols[before_solid & (points == ord(" "))] = SPACE
    marks = np.flatnonzero(points == ord("'"))
    padded = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
    for letters in CONTRACTIONS:
        hit = padded[marks + 1] == ord(letters[0])
        if len(letters) == 2:
            hit &= padded[marks + 2] == ord(letters[1])
        symbols[marks[hit]] = SHORT if len(letters) == 1 else LONG
    return symbols


def split_texts(texts: list[str], automaton: Automaton, table: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The pieces of all texts, each piece's byte offset in its text, and the pieces per text."""
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1  # codepoint where each text starts
    borders = first[1:] - 1
    symbols = symbols_of(points, borders, table)
    starts = np.flatnonzero(automaton.boundaries(symbols))
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    offset = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(size, out=offset[1:])
    begin, end = offset[starts], offset[np.append(starts[1:], len(points))]
    inner = symbols[starts] != BORDER
    data = joined.encode()
    starts, begin, end = starts[inner], begin[inner], end[inner]
    pieces = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    counts = np.diff(np.searchsorted(starts, np.append(first, len(points) + 1)))
    return pieces, begin - np.repeat(offset[first], counts), counts


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the neighbours of lowest rank merge first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 100:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long piece: a heap of pairs over a linked list, n log n steps."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
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
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


class Pieces:
    """Ids of the pieces met so far, in one flat array."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1024, dtype=np.int32)
        self.first = np.zeros(1025, dtype=np.int64)

    def shrink(self) -> None:
        """Keeps the half of the pieces that were met first: frequent ones are among them."""
        self.index = dict(islice(self.index.items(), CACHE_PIECES // 2))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each piece has."""
        if len(self.index) > CACHE_PIECES:
            self.shrink()
        index = self.index
        new = [p for p in dict.fromkeys(pieces) if p not in index]
        if new:
            merged = [merge(p, self.ranks) for p in new]
            had = len(index)
            index.update(zip(new, range(had, had + len(new)), strict=True))
            ends = self.first[had] + np.cumsum([len(m) for m in merged])
            self.first = self._room(self.first, len(index) + 1)
            self.first[had + 1 : len(index) + 1] = ends
            self.ids = self._room(self.ids, ends[-1])
            self.ids[self.first[had] : ends[-1]] = [i for m in merged for i in m]
        at = np.fromiter(map(index.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        counts = self.first[at + 1] - self.first[at]
        return self.ids[ragged(counts, self.first[at])], counts

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        return np.concatenate([array, np.zeros(max(size - len(array), len(array)), dtype=array.dtype)])


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; a vocabulary is under a megabyte and travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


@frugal
def _encode(batches: Iterator[pa.RecordBatch], content: bytes, classes: Broadcast, column: str) -> Iterator[pa.RecordBatch]:
    # both end with the task, as a worker goes on with tasks of other kinds
    cached, automaton = Pieces(parse_ranks(content)), Automaton()
    for batch in batches:
        for rows, texts in text_chunks(batch, column, ENCODED_CHARS):
            pieces, offsets, per_text = split_texts(texts, automaton, classes.value)
            ids, per_piece = cached.encode(pieces)
            edges = np.append(0, np.cumsum(per_text))
            totals = np.append(0, np.cumsum(per_piece))
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    list_array(ids, np.diff(totals[edges]), pa.int32()),
                    list_array(per_piece, per_text, pa.int32()),
                    list_array(offsets, per_text, pa.int32()),
                ],
                names=[*rows.schema.names, "ids", "piece_ids", "piece_starts"],
            )


def encode(df: DataFrame, ranks_path: str, column: str = "text") -> DataFrame:
    """Adds ``ids`` and, per piece, its number of ids and its byte offset in the text.

    A null or empty text has empty lists, an empty table gives an empty one. Columns named like the
    added ones are replaced. The rank file is read where the plan is built. Rows stay in their
    partitions: nothing is shuffled, and repeated rows get equal ids. A text is encoded whole, however
    long, at about 60 bytes a character.
    """
    added = ("ids", "piece_ids", "piece_starts")
    df = df.drop(*[c for c in added if c in df.columns])
    schema = T.StructType([*df.schema, *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in added]])
    classes = df.sparkSession.sparkContext.broadcast(class_table())
    return df.mapInArrow(partial(_encode, content=read_ranks(ranks_path), classes=classes, column=column), schema)


def token_table(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, and each token's size and place there."""
    tokens = {i: t for t, i in parse_ranks(content).items()}
    sizes = np.array([len(tokens.get(i, b"")) for i in range(max(tokens, default=-1) + 1)], dtype=np.int64)
    data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(sizes))), dtype=np.uint8)
    return data, sizes, np.cumsum(sizes) - sizes


@frugal
def _encode_exact(batches: Iterator[pa.RecordBatch], content: bytes, classes: Broadcast, column: str) -> Iterator[pa.RecordBatch]:
    cached, automaton = Pieces(parse_ranks(content)), Automaton()
    data, sizes, first = token_table(content)
    for batch in batches:
        for rows, texts in text_chunks(batch, column, ENCODED_CHARS):
            pieces, _, per_text = split_texts(texts, automaton, classes.value)
            ids, per_piece = cached.encode(pieces)
            edges = np.append(0, np.cumsum(per_piece))[np.append(0, np.cumsum(per_text))]
            ends = np.append(0, np.cumsum(sizes[ids]))[edges].tolist()
            decoded = data[ragged(sizes[ids], first[ids])].tobytes()
            exact = [decoded[a:b] == t.encode() for a, b, t in zip(ends, ends[1:], texts, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, list_array(ids, np.diff(edges), pa.int32()), pa.array(exact, pa.bool_())],
                names=[*rows.schema.names, "ids", "exact"],
            )


def encode_exact(df: DataFrame, ranks_path: str, column: str = "text") -> DataFrame:
    """Adds ``ids`` as :func:`encode`, and ``exact``, whether they decode to the text's bytes.

    Decoding follows in the same task, so neither ids nor bytes travel in between.
    """
    df = df.drop("ids", "exact")
    schema = T.StructType([*df.schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    classes = df.sparkSession.sparkContext.broadcast(class_table())
    return df.mapInArrow(partial(_encode_exact, content=read_ranks(ranks_path), classes=classes, column=column), schema)


@frugal
def _decode(batches: Iterator[pa.RecordBatch], content: bytes, column: str) -> Iterator[pa.RecordBatch]:
    data, sizes, first = token_table(content)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()], dtype=np.int64)
        edges = np.append(0, np.cumsum(counts))
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            own = ids[a:b]
            out.append(data[ragged(sizes[own], first[own])].tobytes())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(out, type=pa.binary())], names=[*batch.schema.names, "decoded"]
        )


def decode(df: DataFrame, ranks_path: str, column: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of the listed ids; a null or empty list gives no bytes.

    Ids must be those of tokens. A column of that name is replaced; an empty table gives an empty one.
    """
    df = df.drop("decoded")
    schema = T.StructType([*df.schema, T.StructField("decoded", T.BinaryType())])
    return df.mapInArrow(partial(_decode, content=read_ranks(ranks_path), column=column), schema)
