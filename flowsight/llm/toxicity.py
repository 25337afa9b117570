"""Toxic spans by a linear-chain conditional random field.

The labelled documents say which texts are toxic, not which words. A word of a toxic text counts as
toxic if the text itself, or its beginning of four to six letters, is bound to toxic texts beyond
chance; those labelled tokens train the field: two states, weights for the word's form, and weights
for the steps between states. In a text, forward-backward marginals give each word's probability;
they add up to the text's score, and words above one half are the offending offsets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.llm.common import frugal, give_back, text_chunks

WORD = re.compile(r"\w+")
#: Positions that are worked on one after the other; the blocks are worked on side by side.
BLOCK = 64
#: Words whose scores a task remembers.
CACHE_WORDS = 100_000
#: Characters that are scored at a time; a longer text is scored alone.
SCORED_CHARS = 400_000
#: How far beyond chance a form must be to explain toxic texts that nothing else explains.
COVER_GAIN = 5.0
ONES = np.ones(2)


def forms(word: str) -> list[str]:
    """The features of a word: itself, its beginnings and its end."""
    w = word.lower()
    return [f"={w}", *[f"^{w[:k]}" for k in (3, 4, 5, 6, 8) if len(w) >= k], f"${w[-3:]}"]


@dataclass
class Chain:
    """Weights of the field: features for the toxic state, bias, steps (clean to toxic, back, stay)."""

    weights: dict[str, float]
    bias: float
    steps: tuple[float, float, float]
    #: Document score: weights of the strongest evidence and of the expected number, and a constant.
    document: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in forms(word))


def forward(x: np.ndarray, first: np.ndarray, steps: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward sums (clean, toxic) of concatenated chains; ``x`` are the toxic state's factors.

    Each position is a two-by-two matrix, so chains are cut into blocks: the blocks' matrix products
    give every block its entry, and all blocks then run side by side.
    """
    n = len(x)
    to, back, stay = np.exp(steps)
    blocks = -(-n // BLOCK)
    padded = np.ones(blocks * BLOCK)
    padded[:n] = x
    begins = np.zeros(blocks * BLOCK, dtype=bool)
    begins[:n] = first
    x, begins = (np.ascontiguousarray(v.reshape(blocks, BLOCK).T) for v in (padded, begins))
    # rows of the block's product: what entering clean or toxic leads to
    rows = [[np.ones(blocks), np.zeros(blocks)], [np.zeros(blocks), np.ones(blocks)]]

    def advance(clean: np.ndarray, toxic: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        new_clean, new_toxic = clean + toxic * back, (clean * to + toxic * stay) * x[j]
        if begins[j].any():
            new_clean = np.where(begins[j], clean + toxic, new_clean)
            new_toxic = np.where(begins[j], (clean + toxic) * to * x[j], new_toxic)
        return new_clean, new_toxic

    for j in range(BLOCK):
        rows = [list(advance(*row, j)) for row in rows]
        scale = rows[0][0] + rows[0][1] + rows[1][0] + rows[1][1]
        rows = [[v / scale for v in row] for row in rows]
    (cc, ct), (tc, tt) = ((v.tolist() for v in row) for row in rows)
    clean, toxic = [1.0] * blocks, [0.0] * blocks
    a, b = 1.0, 0.0
    for i in range(blocks):
        clean[i], toxic[i] = a, b
        a, b = a * cc[i] + b * tc[i], a * ct[i] + b * tt[i]
        s = a + b or 1.0
        a, b = a / s, b / s
    a, b = np.array(clean), np.array(toxic)
    out = np.empty((2, BLOCK, blocks))
    for j in range(BLOCK):
        a, b = advance(a, b, j)
        s = a + b
        a, b = a / s, b / s
        out[0, j], out[1, j] = a, b
    return out[0].T.reshape(-1)[:n], out[1].T.reshape(-1)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, steps: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state at each position, and expected steps (to, back, stay)."""
    if not len(emission):
        return np.zeros(0), np.zeros(3)
    x = np.exp(np.clip(emission, -30, 30))
    clean, toxic = forward(x, first, steps)
    to, back, stay = np.exp(steps)
    # Backwards, the chain with its own factor divided out again is the same recursion mirrored.
    last = np.append(first[1:], True)
    seen_clean, seen_toxic = backward(x, last, steps)
    up = toxic * seen_toxic
    p = up / (up + clean * seen_clean)
    inner = np.flatnonzero(~first)
    a, b = clean[inner - 1], toxic[inner - 1]
    u, v = seen_clean[inner], seen_toxic[inner] * x[inner]
    flows = np.array([a * to * v, b * back * u, b * stay * v])
    total = a * u + flows.sum(0)
    return p, (flows / total).sum(1)


def chained_marginals(emission: np.ndarray, flat: np.ndarray, first: np.ndarray, steps: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The same for words given by number, some whole chains at a time to save memory."""
    begins = np.flatnonzero(first)
    at = np.searchsorted(begins, np.arange(0, len(flat), 200_000))
    edges = np.unique(np.concatenate([begins[at[at < len(begins)]], [len(flat)]]))
    p, expected = np.empty(len(flat)), np.zeros(3)
    for a, b in zip(edges, edges[1:], strict=False):
        p[a:b], flows = marginals(emission[flat[a:b]], first[a:b], steps)
        expected += flows
    return p, expected


def backward(x: np.ndarray, last: np.ndarray, steps: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled backward sums: what follows each position, given its state."""
    # Mirrored, with (clean, toxic) after a position's own factor: one forward run whose entry from
    # clean to toxic and from toxic to clean change places.
    to, back, stay = steps
    n = len(x)
    mirrored_first = last[::-1]
    # forward() weighs a chain's first toxic state by the entry step; undo that for the mirrored end.
    y = x[::-1] * np.where(mirrored_first, np.exp(-back), 1.0)
    clean, toxic = forward(y, mirrored_first, (back, to, stay))
    # own factor out: what the position after it (before it in the mirror) sends here
    seen_clean, seen_toxic = np.ones(n), np.ones(n)
    inner = np.flatnonzero(~mirrored_first)
    a, b = clean[inner - 1], toxic[inner - 1]
    seen_clean[inner] = a + b * np.exp(to)
    seen_toxic[inner] = a * np.exp(back) + b * np.exp(stay)
    return seen_clean[::-1], seen_toxic[::-1]


def beyond_chance(toxic: np.ndarray, clean: np.ndarray, share: float, scale: np.ndarray = ONES) -> np.ndarray:
    """How unlikely it is that so many of a form's texts are toxic by chance.

    The exponent of a binomial tail bound over the texts at hand; 0 for forms that clean texts hold too
    often. That is judged by what clean and toxic texts stand for (``scale``), not by their numbers here.
    """
    n = toxic + clean
    q = toxic / np.maximum(n, 1)
    precision = toxic * scale[1] / np.maximum(toxic * scale[1] + clean * scale[0], 1e-12)
    rest = np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - share)), 0.0)
    return np.where((q > share) & (precision > 0.8), n * (q * np.log(np.maximum(q, 1e-12) / share) + rest), 0.0)


def toxic_words(types: list[str], texts: list[np.ndarray], y: np.ndarray, scale: np.ndarray = ONES) -> np.ndarray:
    """Which words mark a toxic text: bound words, and words with a bound beginning.

    A form is bound if its count is beyond chance for all forms that are tried: the texts that hold
    it, or, for beginnings, those that hold it twice. Beginnings are
    counted over the words that aren't bound themselves, so that one frequent word doesn't speak for
    all that begin like it. Toxic texts that are still without a mark are then explained one form at
    a time, by the one that covers most of them.
    """
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return np.zeros(len(types), dtype=bool)

    def counts(texts: list[np.ndarray], size: int, labels: np.ndarray = y, times: int = 1) -> list[np.ndarray]:
        """Clean and toxic texts that hold each form so many times."""
        out = [np.zeros(size, dtype=np.int64) for _ in range(2)]
        for own, label in zip(texts, labels, strict=True):
            form, n = np.unique(own, return_counts=True)
            out[label][form[n >= times]] += 1
        return out

    def bound(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        return beyond_chance(toxic, clean, share, scale) > np.log((toxic > 0).sum() + 1) + 2

    clean, toxic = counts(texts, len(types))
    clean_words, marked = clean, bound(toxic, clean)
    words = np.array([len(w) for w in types])
    forms = []
    for k in (4, 5, 6):
        names: dict[str, int] = {}
        stem = np.array([names.setdefault(w[:k], len(names)) if len(w) >= k else -1 for w in types], dtype=np.int64)
        forms.append((stem, len(names)))
        rest = np.where(marked, -1, stem)
        # A beginning that clean texts have by chance too is bound if only toxic ones repeat it.
        for times in (1, 2):
            clean, toxic = counts([s[s >= 0] for s in (rest[t] for t in texts)], len(names), times=times)
            marked = marked | np.append(bound(toxic, clean), False)[rest]

    cleans = [counts([s[s >= 0] for s in (stem[t] for t in texts)], n)[0] for stem, n in forms]
    forms.append((np.where(words > 1, np.arange(len(types)), -1), len(types)))
    cleans.append(clean_words)
    while open_ := [t for t, label in zip(texts, y, strict=True) if label and not marked[t].any()]:
        best = (COVER_GAIN, None, None)
        for (stem, n), clean in zip(forms, cleans, strict=True):
            toxic = counts([s[s >= 0] for s in (stem[t] for t in open_)], n, np.ones(len(open_), dtype=np.int64))[1]
            gain = np.where(toxic >= 3, beyond_chance(toxic, clean, share, scale), 0.0)
            at = int(np.argmax(gain)) if n else 0
            if n and gain[at] > best[0]:
                best = (gain[at], stem, at)
        if best[1] is None:
            break
        marked = marked | (best[1] == best[2])
    return marked


def different(texts: list[np.ndarray], types: list[str], bands: int = 8, width: int = 4) -> list[int]:
    """Places of texts that are no near copies of earlier ones, by banded minima of word hashes.

    All words of a toxic text that has many copies would seem bound to toxic texts.
    """
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 2**62, bands * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    crc = np.array([zlib.crc32(w.encode()) for w in types] or [0], dtype=np.uint64)
    seen: set[tuple] = set()
    out = []
    for i, own in enumerate(texts):
        hashes = crc[np.unique(own)] if len(own) else crc[:1]
        with np.errstate(over="ignore"):
            least = (hashes[:, None] * factors >> np.uint64(20)).min(0).reshape(bands, width).tolist()
        keys = [(b, *row) for b, row in enumerate(least)]
        if not any(k in seen for k in keys):
            out.append(i)
        seen.update(keys)
    return out


def train(texts: list[str], labels: list[int], rounds: int = 30, counts: tuple[int, int] | None = None) -> Chain:
    """Fits the field and the document score on whole labelled texts, in memory.

    ``counts`` are the clean and toxic texts that the given ones are a sample of; each then counts as
    many times as its label was thinned, so that scores keep the meaning that they have without a sample.
    """
    given = np.bincount(np.array(labels, dtype=np.int64), minlength=2)
    scale = np.array(given if counts is None else counts) / np.maximum(given, 1)
    index: dict[str, int] = {}
    tokens = [
        np.array([index.setdefault(w, len(index)) for w in WORD.findall(t.lower())], dtype=np.int32) for t in texts
    ]
    types = list(index)
    chosen = different(tokens, types)
    chosen.sort(key=lambda i: labels[i])  # clean texts first
    tokens, y = [tokens[i] for i in chosen], np.array([labels[i] for i in chosen], dtype=np.int64)
    marked = toxic_words(types, tokens, y, scale)
    if not marked.any():  # nothing to learn from: all texts score the share of toxic ones
        share = min(max(float(np.average(y, weights=scale[y])) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return Chain({}, -12.0, (0.0, 0.0, 0.0), (0.0, 0.0, math.log(share / (1 - share))))
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.concatenate(tokens)
    first = np.zeros(len(flat), dtype=bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    truth = marked[flat] & np.repeat(y == 1, lengths)

    names: dict[str, int] = {}
    sizes = np.fromiter((len(forms(w)) for w in types), dtype=np.int64, count=len(types))
    rows = np.repeat(np.arange(len(types)), sizes)
    columns = np.fromiter((names.setdefault(f, len(names)) for w in types for f in forms(w)), dtype=np.int64, count=len(rows))
    observed = scale[1] * np.bincount(flat[truth], minlength=len(types))
    before, here = truth[:-1][~first[1:]], truth[1:][~first[1:]]
    seen = np.array([(~before & here).sum(), (before & ~here).sum(), (before & here).sum()], dtype=float)
    seen[0] += truth[first].sum()
    seen *= scale[1]
    parts = [slice(0, int(lengths[y == 0].sum())), slice(int(lengths[y == 0].sum()), len(flat))]
    times = np.repeat(scale[y], lengths)

    def weighted_marginals(emission: np.ndarray, steps: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
        found = [chained_marginals(emission, flat[own], first[own], steps) for own in parts]
        return np.concatenate([p for p, _ in found]), sum(w * flows for w, (_, flows) in zip(scale, found, strict=True))

    weights, bias, steps = np.zeros(len(names)), -4.0, np.zeros(3)
    # full-batch Adam on the likelihood, with a small pull to zero
    moment, spread = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for r in range(1, rounds + 1):
        emission = bias + np.bincount(rows, weights=weights[columns], minlength=len(types))
        p, expected = weighted_marginals(emission, tuple(steps))
        expected[0] += (p * times)[first].sum()
        miss = observed - np.bincount(flat, weights=p * times, minlength=len(types))
        by_form = np.bincount(columns, weights=miss[rows], minlength=len(names)) - 0.02 * weights
        gradient = np.concatenate([by_form, [miss.sum()], seen - expected - 0.1 * steps])
        moment = 0.9 * moment + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        move = 0.3 * (moment / (1 - 0.9**r)) / (np.sqrt(spread / (1 - 0.99**r)) + 1e-8)
        weights += move[: len(names)]
        bias += move[len(names)]
        steps = np.clip(steps + move[len(names) + 1 :], -4, 4)
    kept = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-3}
    chain = Chain(kept, float(bias), tuple(map(float, steps)))
    emission = bias + np.bincount(rows, weights=weights[columns], minlength=len(types))
    p, _ = weighted_marginals(emission, chain.steps)
    chain.document = calibrate(evidence(p, lengths), y, scale[y])
    return chain


def evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: log-odds that any word is toxic, and the logarithm of the expected number."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    none = np.bincount(owner, weights=np.log1p(-p), minlength=len(lengths))
    number = np.bincount(owner, weights=p, minlength=len(lengths))
    odds = np.clip(np.log(np.maximum(-np.expm1(none), 1e-12)) - none, -12, 12)
    return np.column_stack([odds, np.log1p(number), np.ones(len(lengths))])


def calibrate(x: np.ndarray, y: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[float, float, float]:
    """Logistic regression of the label on the evidence, by Newton steps; each text counts ``times``."""
    w = np.array([0.5, 0.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (y - p)) - 0.5 * w * [1, 1, 0]
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag([0.5, 0.5, 1e-3])
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return tuple(map(float, w))


def document_scores(x: np.ndarray, chain: Chain) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(chain.document), -30, 30)))


class Emissions(dict):
    def __init__(self, chain: Chain) -> None:
        super().__init__()
        self.chain = chain

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = self.chain.emission(word)
        return value


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


@frugal
def _score(batches: Iterator[pa.RecordBatch], sent: Broadcast, column: str) -> Iterator[pa.RecordBatch]:
    chain = sent.value
    known = Emissions(chain)
    for batch in batches:
        for rows, texts in text_chunks(batch, column, SCORED_CHARS):
            words = [WORD.findall(t) for t in texts]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            total = int(lengths.sum())
            emission = np.fromiter((known[w] for own in words for w in own), dtype=np.float64, count=total)
            begin = np.cumsum(lengths) - lengths
            first = np.zeros(total, dtype=bool)
            first[begin[lengths > 0]] = True
            p, _ = marginals(emission, first, chain.steps)
            scores = document_scores(evidence(p, lengths), chain)
            spans = [[] for _ in texts]
            for at in np.flatnonzero(p > 0.5).tolist():
                spans[int(np.searchsorted(begin, at, "right")) - 1].append(at)
            out = []
            for text, start, marked in zip(texts, begin.tolist(), spans, strict=True):
                places = [m.span() for m in WORD.finditer(text)] if marked else []
                out.append([{"start": places[i - start][0], "end": places[i - start][1], "probability": float(p[i])} for i in marked])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(scores), pa.array(out, type=SPANS)],
                names=[*rows.schema.names, "toxicity", "toxic_spans"],
            )


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", rows_per_label: tuple[int, int] = (2000, 1000)) -> Chain:
    """Trains on at most ``rows_per_label`` clean and toxic documents, those of smallest key hash.

    The bound keeps the training texts in the driver's memory; all labels are counted, and each text
    stands for as many of its label as were thinned to it. Labels other than 0 and 1 and labels
    without a document teach nothing, and of a repeated label the larger counts. Of a repeated document
    the first text in order is taken.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    known = known.join(documents.select(key).distinct(), key, "left_semi")
    found = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    counts = found.get(0, 0), found.get(1, 0)
    parts = [
        known.filter(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(rows_per_label[value]) for value in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1])
    # as many rows of two numbers as rows_per_label allows, and so many texts
    rows = documents.select(key, F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), key)
    rows = rows.groupBy(key).agg(F.min("text").alias("text"), F.max("_label").alias("_label")).collect()
    rows = sorted(rows, key=lambda r: r[0])
    chain = train([r["text"] or "" for r in rows], [r["_label"] for r in rows], counts=counts)
    del rows
    give_back()
    return chain


def score(df: DataFrame, chain: Chain, column: str = "text") -> DataFrame:
    """Adds ``toxicity`` (0 to 1) and ``toxic_spans`` (start, end, probability; code points).

    Words are runs of letters, digits and underscores. A null or empty text has the score of no
    evidence and no spans; columns named like the added ones are replaced. Nothing is shuffled and
    rows are not compared, so repeated rows get equal scores; texts of any length are scored whole, an
    empty table gives an empty one. The model, bounded by its training texts, goes to every task.
    """
    df = df.drop("toxicity", "toxic_spans")
    span = T.StructType().add("start", "integer").add("end", "integer").add("probability", "double")
    schema = T.StructType([*df.schema, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", T.ArrayType(span))])
    sent = df.sparkSession.sparkContext.broadcast(chain)
    return df.mapInArrow(partial(_score, sent=sent, column=column), schema)
