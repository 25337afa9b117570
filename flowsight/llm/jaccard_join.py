"""Near-duplicate documents: an exact n-gram Jaccard join in size-banded tiles.

A document is its set of hashed shingles; equal sets become one node. Two sets of Jaccard similarity
t or more share one of the first n - ceil(t n) + 1 shingles of each in any common order, so nodes meet
in the tiles of those shingles. The order puts the shingles that many documents share last (a bounded
table of them only sets the order; any order is exact). Every node has a bitmap: each shingle flips
one bit, so the bits in which two bitmaps differ are at most the shingles in which the sets differ,
and the bit count bounds the overlap from above. Its width follows the size of the set.

First every node is compared with one central node of its tiles (its star), so the members of a group
of copies become one component without all their pairs. Then, in the tiles that still hold different
components, nodes of neighbouring size bands and different components are compared by bitmap, in
blocks of bounded size: a round for the nearest ones, and one for all that is still apart. Every
round ends in the exact intersection of sorted arrays, made from the documents' texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.llm.common import frugal, numbered, ragged, text_chunks
from flowsight.llm.components import components
from flowsight.llm.hashing import ODD, Sequence, mixed, word_hashes
from flowsight.session import materialize

#: Characters whose shingles are worked out at a time; a longer text is taken alone.
HASHED_CHARS = 500_000
#: Shared shingles whose places in the order are sent to all tasks: 16 bytes each.
ORDERED_SHINGLES = 100_000
#: Shingles among which a task looks for shared ones at a time.
COUNTED_SHINGLES = 2_000_000
#: Rows of one tile; a shingle that more nodes share is compared block by block.
TILE_ROWS = 1000
#: Pairs whose numbers may travel to all tasks instead of the texts to the pairs: 16 bytes each.
SENT_PAIRS = 1_000_000
#: Nearest nodes of other components that a node is compared with, round by round, before all are.
NEAREST = (1,)
#: Tiles of so few rows are compared pair by pair; arrays would cost more to set up.
FEW_ROWS = 16
#: Bitmap words compared at a time.
CELLS = 2_000_000


def shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``n`` words, or of all its words if fewer."""
    hashes, counts = word_hashes([t.encode().lower() for t in texts])
    sequence = Sequence(hashes)
    begin = np.cumsum(counts) - counts
    size = np.minimum(counts, n)
    own = np.where(counts > 0, counts - size + 1, 0)
    runs = sequence.runs(ragged(own, begin), np.repeat(size, own))
    return [np.unique(x) for x in np.split(runs, np.cumsum(own)[:-1])]


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: a power of two, about one to two per shingle."""
    return 1 << max(6, min(16, int(n).bit_length()))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap: every shingle flips the bit that its hash names."""
    width = width_of(len(tokens))
    bits = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) brought to a smaller width, which keeps parities."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def node_of(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mixed(tokens * ODD).sum(dtype=np.uint64) * ODD + np.uint64(len(tokens))
    return int(mixed(np.array([total]))[0].view(np.int64))


@frugal
def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows (token, seen) of the shingles that some of them share."""
    pending, waiting = [], 0
    names = ["_row", "size", "node", "bits", "token", "seen"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def shared() -> pa.RecordBatch:
        tokens, seen = np.unique(np.concatenate(pending), return_counts=True)
        often = seen > 1
        tokens, seen = tokens[often].view(np.int64), seen[often]
        none = [pa.nulls(len(tokens), k) for k in kinds[:4]]
        return pa.RecordBatch.from_arrays([*none, pa.array(tokens), pa.array(seen, pa.int64())], names=names)

    for batch in batches:
        for rows, texts in text_chunks(batch, limit=HASHED_CHARS):
            sets = shingles(texts, n)
            columns = [
                rows.column("_row"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) for s in sets], pa.int64()),
                pa.array([bitmap(s) for s in sets], pa.binary()),
                *(pa.nulls(len(sets), k) for k in kinds[4:]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            pending += sets
            waiting += sum(map(len, sets))
            if waiting > COUNTED_SHINGLES:
                yield shared()
                pending, waiting = [], 0
    if pending:
        yield shared()


def prefix(tokens: np.ndarray, shared: np.ndarray, places: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles by which a set can meet a similar one, and how many of them are unshared ones.

    Unshared ones come first, by hash, then the shared ones by their places.
    """
    n = len(tokens)
    take = n - -(-percent * n // 100) + 1
    if not len(shared):
        return tokens[:take], take
    at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
    hit = shared[at] == tokens
    first = tokens[~hit][:take]
    late = tokens[hit][np.argsort(places[at[hit]], kind="stable")][: take - len(first)]
    return np.concatenate([first, late]), len(first)


@frugal
def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, order: Broadcast) -> Iterator[pa.RecordBatch]:
    done = set()
    shared, places = order.value
    for batch in batches:
        for _, texts in text_chunks(batch, limit=HASHED_CHARS):
            out = []
            for tokens in shingles(texts, n):
                node = node_of(tokens) if len(tokens) else None
                if node is None or node in done:
                    continue  # copies in this task
                if len(done) < 1_000_000:
                    done.add(node)
                own, unshared = prefix(tokens, shared, places, percent)
                salt = np.where(np.arange(len(own)) < unshared, 0, 1 + node % 31)
                out.append((own, np.full(len(own), node), np.full(len(own), len(tokens)), salt))
            if out:
                token, node, size, salt = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(salt, pa.int32())],
                    names=["token", "node", "size", "salt"],
                )


@frugal
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, then node: those whose token has different nodes, once each.

    Shared shingles are spread over tasks by their salt, so all their rows are kept.
    """
    last, sent = np.zeros((4, 0), dtype=np.int64), False
    for batch in batches:
        rows = np.array([batch.column(i).to_numpy() for i in range(4)], dtype=np.int64)
        rows = np.hstack([last, rows])
        rows = rows[:, np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(0)]] if rows.shape[1] else rows
        if not rows.shape[1]:
            continue
        same = rows[0, 1:] == rows[0, :-1]
        keep = rows[3] > 0
        keep[1:] |= same
        keep[:-1] |= same
        out = keep.copy()
        if last.shape[1] and sent:
            out[0] = False
        # The last row may meet the next batch; it must not be sent twice.
        last, sent = rows[:, -1:], bool(keep[-1])
        kept = rows[:, out]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2], pa.int32())], names=["token", "node", "size"]
        )


def within(size_a, size_b, differ, percent: int):
    """Whether sets of these sizes that differ in ``differ`` shingles or more can be similar enough.

    With d differing shingles the overlap is (a + b - d) / 2 at most, the union (a + b + d) / 2 at
    least.
    """
    return 100 * (size_a + size_b - differ) >= percent * (size_a + size_b + differ)


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Differing bits of each pair of bitmaps, at the smaller width of the two."""
    out = np.zeros(len(a), dtype=np.int64)
    widths = [(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    for pair in set(widths):
        at = [i for i, w in enumerate(widths) if w == pair]
        words = min(pair) // 8
        x = folded(np.frombuffer(b"".join(a[i] for i in at), dtype=np.uint64).reshape(len(at), -1), words)
        y = folded(np.frombuffer(b"".join(b[i] for i in at), dtype=np.uint64).reshape(len(at), -1), words)
        out[at] = np.bitwise_count(x ^ y).sum(1)
    return out


@frugal
def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that the bit counts leave possible."""
    for batch in batches:
        if batch.num_rows:
            differ = differing(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())
            a, b = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            keep = within(a, b, differ, percent) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            yield batch.select(["a", "b"]).filter(pa.array(keep))


@frugal
def _tiles(batches: Iterator[pa.RecordBatch], percent: int, nearest: int | None) -> Iterator[pa.RecordBatch]:
    """Possible pairs of different components in each tile; rows come sorted by tile.

    All of them, or for each node those with its ``nearest`` nodes by bitmap.
    """
    rest: list[dict] = []
    for batch in batches:
        rows = rest + batch.to_pylist()
        tile = lambda r: (r["token"], r["left"], r["right"])
        edges = [0, *[i for i in range(1, len(rows)) if tile(rows[i]) != tile(rows[i - 1])], len(rows)]
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield from _pairs(rows[a:b], percent, nearest)
        rest = rows[edges[-2] :] if rows else []
    if rest:
        yield from _pairs(rest, percent, nearest)


def _pairs(rows: list[dict], percent: int, nearest: int | None) -> Iterator[pa.RecordBatch]:
    """``rows`` are one tile: a block with itself, or two blocks of a shared shingle."""
    found = _few(rows, percent) if len(rows) <= FEW_ROWS else _many(rows, percent)
    left, right, apart = found
    left, right = left.astype(np.int64), right.astype(np.int64)
    if nearest is not None and len(left):
        own = np.concatenate([left, right])
        order = np.lexsort((np.concatenate([apart, apart]), own))
        rank = np.arange(len(own)) - np.searchsorted(own[order], own[order])
        kept = np.unique(order[rank < nearest] % len(left))
        left, right = left[kept], right[kept]
    if len(left):
        node = np.array([r["node"] for r in rows])
        x, y = node[left], node[right]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _few(rows: list[dict], percent: int) -> np.ndarray:
    """Possible pairs of a small tile: places of both rows and their distance per shingle."""
    found = []
    crossing = rows[0]["left"] != rows[0]["right"]
    for i, r in enumerate(rows):
        for j in range(i):
            s = rows[j]
            a, b = r["size"], s["size"]
            apart = r["component"] != s["component"] and 100 * min(a, b) >= percent * max(a, b)
            if apart and not (crossing and r["block"] == s["block"]):
                x, y = r["bits"], s["bits"]
                m, n = (int.from_bytes(v, "little") for v in (x, y))
                for _ in range(len(x).bit_length() - len(y).bit_length()):
                    x = x[len(x) // 2 :]
                    m = (m & ((1 << 8 * len(x)) - 1)) ^ (m >> 8 * len(x))
                for _ in range(len(y).bit_length() - len(x).bit_length()):
                    y = y[len(y) // 2 :]
                    n = (n & ((1 << 8 * len(y)) - 1)) ^ (n >> 8 * len(y))
                differ = (m ^ n).bit_count()
                if within(a, b, differ, percent):
                    found.append((j, i, differ / (a + b)))
    return np.array(found).reshape(-1, 3).T


def _many(rows: list[dict], percent: int) -> np.ndarray:
    """The same for a large tile, by arrays."""
    size = np.array([r["size"] for r in rows], dtype=np.int64)
    component = np.array([r["component"] for r in rows])
    block = np.array([r["block"] for r in rows])
    crossing = rows[0]["left"] != rows[0]["right"]
    widths = np.array([len(r["bits"]) for r in rows])
    found = [np.zeros((3, 0))]
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        bits = np.frombuffer(b"".join(rows[i]["bits"] for i in own), dtype=np.uint64).reshape(len(own), -1)
        # similar sizes have the same width or neighbouring ones
        for other in (w, 2 * w):
            theirs = np.flatnonzero(widths == other)
            if not len(theirs):
                continue
            more = np.frombuffer(b"".join(rows[i]["bits"] for i in theirs), dtype=np.uint64).reshape(len(theirs), -1)
            more = folded(more, w // 8)
            step = max(1, CELLS // (len(theirs) * max(1, w // 8)))
            for start in range(0, len(own), step):
                part = own[start : start + step]
                a, b = size[part][:, None], size[theirs][None, :]
                maybe = (component[part][:, None] != component[theirs]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                if crossing:
                    maybe &= block[part][:, None] != block[theirs]
                if other == w:
                    maybe &= part[:, None] < theirs
                if not maybe.any():
                    continue
                differ = np.bitwise_count(bits[start : start + step][:, None, :] ^ more[None, :, :]).sum(-1, dtype=np.int64)
                i, j = np.nonzero(maybe & within(a, b, differ, percent))
                found.append(np.array([part[i], theirs[j], differ[i, j] / (size[part[i]] + size[theirs[j]])]))
    return np.hstack(found)


@frugal
def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose exact similarity is high enough; texts of one side often repeat in a row."""
    last, tokens = None, None
    for batch in batches:
        for rows, lefts in text_chunks(batch, "text_a", HASHED_CHARS):
            kept = []
            sides = zip(shingles(lefts, n), rows.column("b").to_pylist(), rows.column("text_b"), strict=True)
            for own, key, right in sides:
                if key != last:
                    last, tokens = key, shingles([right.as_py()], n)[0]
                both = len(np.intersect1d(own, tokens, assume_unique=True))
                kept.append(both > 0 and 100 * both >= percent * (len(own) + len(tokens) - both))
            yield rows.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _sent(pairs: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(pairs) if few else pairs


def verified(rows: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of (a, b), numbers of rows: the pairs of similar texts. Only the texts of pairs are shuffled.

    The numbers of the pairs go to all tasks while they are at most ``SENT_PAIRS``, else they are
    joined by shuffles; the answer is the same.
    """
    few = pairs.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS
    left = rows.select(F.col("_row").alias("a"), F.col("text").alias("text_a")).join(_sent(pairs, few), "a")
    needed = _sent(pairs.select("b").distinct(), few)
    right = rows.select(F.col("_row").alias("b"), F.col("text").alias("text_b")).join(needed, "b")
    return left.hint("merge").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        partial(_verify, n=n, percent=percent), "a long, b long"
    )


def similar_components(rows: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(_row, size, component) of every row, and the links (a, b) that were found, as numbers of rows.

    ``rows`` has ``_row`` (unique long) and ``text``. The links connect all that is similar, but
    need not hold every similar pair: copies hang on one of them, and a pair that is in one component
    already is not compared.
    """
    spark = rows.sparkSession
    sketch = rows.mapInArrow(partial(_sketch, n=n), "_row long, size long, node long, bits binary, token long, seen long")
    sketch = materialize(sketch, "sketches")
    documents = sketch.filter(F.col("_row").isNotNull()).select("_row", "size", "node", "bits")
    common = (
        sketch.filter(F.col("token").isNotNull())
        .groupBy("token")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "token")
        .limit(ORDERED_SHINGLES)
        .toArrow()
    )
    tokens = common["token"].to_numpy().view(np.uint64)
    by_hash = np.argsort(tokens)
    order = spark.sparkContext.broadcast((tokens[by_hash], -by_hash))  # the rarer of them first
    met = rows.mapInArrow(
        partial(_prefixes, n=n, percent=percent, order=order), "token long, node long, size int, salt int"
    )
    met = met.repartition("token", "salt").sortWithinPartitions("token", "node")
    met = materialize(met.mapInArrow(_met, "token long, node long, size int"), "tiles")

    # A node is known by its first row from here on.
    filled = documents.filter(F.col("size") > 0)
    first = filled.groupBy("node").agg(F.min("_row").alias("row"))
    nodes = materialize(filled.join(first.withColumnRenamed("row", "_row"), ["node", "_row"]), "nodes")

    # Stars: in each tile and size band the most central node is the head, the one whose shingles
    # most others share: the original of a group of edited copies rather than one of them.
    band = F.floor(F.log(F.col("size")) / F.log(F.lit(100 / percent)))
    held = materialize(met.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "tile-sizes")
    pull = met.join(held, "token").groupBy("node").agg((F.sum("rows") / F.first("size")).alias("pull"))
    banded = met.join(materialize(pull, "pull"), "node").withColumn("band", band)
    banded = materialize(banded.select("token", "band", "node", "pull"), "banded")
    heads = banded.groupBy("token", "band").agg(F.max(F.struct("pull", "node")).alias("head"))
    heads = materialize(heads.select("token", "band", F.col("head.node").alias("head")), "heads")
    meetings = banded.join(heads, ["token", "band"]).filter(F.col("node") != F.col("head")).groupBy("node", "head").count()
    stars = meetings.groupBy("node").agg(F.max(F.struct("count", "head")).alias("best"))
    stars = stars.select("node", F.col("best.head").alias("head"))

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs of nodes within the bit-count bound, as pairs of rows."""
        a = nodes.select(F.col("node").alias("x"), F.col("_row").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
        b = nodes.select(F.col("node").alias("y"), F.col("_row").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
        both = pairs.join(a, "x").join(b, "y").drop("x", "y")
        return both.mapInArrow(partial(_bounded, percent=percent), "a long, b long")

    pairs = materialize(possible(stars.select(F.col("node").alias("x"), F.col("head").alias("y"))), "pairs")
    links = materialize(verified(rows, pairs, n, percent), "links")
    labels = components(links)

    # Tiles with different components: first each node's nearest ones, round after round, then all
    # that is still apart.
    by_row = nodes.select("node", "_row")
    for nearest in (*NEAREST, None):
        named = nodes.join(labels.withColumnRenamed("node", "_row"), "_row", "left").select(
            "node", "bits", F.coalesce("label", "_row").alias("component")
        )
        rest = possible_in_tiles(met, materialize(named, "components"), percent, nearest)
        rest = rest.join(by_row.select(F.col("node").alias("a"), F.col("_row").alias("x")), "a").join(
            by_row.select(F.col("node").alias("b"), F.col("_row").alias("y")), "b"
        )
        rest = materialize(rest.select(F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
        more = materialize(verified(rows, rest, n, percent), "links")
        links = links.unionByName(more)
        labels = components(links)
    final = nodes.join(labels.withColumnRenamed("node", "_row"), "_row", "left").select(
        "node", F.coalesce("label", "_row").alias("component")
    )
    sized = documents.select("_row", "size", "node").join(final, "node", "left")
    own = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("_row"))
    return sized.select("_row", "size", own.alias("component")), links


def possible_in_tiles(met: DataFrame, named: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Pairs of nodes of different components that meet in a tile and that the bit counts allow.

    ``met`` has (token, node, size), ``named`` (node, bits, component). The tile of a shingle that
    many nodes share is cut into blocks, and every two blocks are a tile.
    """
    mixed_tiles = (
        met.join(named.select("node", "component"), "node")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("token", F.ceil(F.col("rows") / TILE_ROWS).alias("blocks"))
    )
    open_rows = met.join(materialize(mixed_tiles, "mixed-tiles"), "token").join(named, "node")
    blocked = open_rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn(
        "with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    tiled = blocked.select(
        "token", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"),
        "size", "node", "component", "block", "bits",
    )
    tiled = tiled.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right")
    return tiled.mapInArrow(partial(_tiles, percent=percent, nearest=nearest), "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", column: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): every document with its set's size and its group.

    Texts are lower-cased (A to Z); words are runs of characters other than space and U+0009 to
    U+000D. Two documents link if 100 * shared >= percent * all shingles of ``n`` words; a group is
    what links connect, named by its smallest key. A document of fewer words is its whole sequence;
    one without words or with a null text is alone. Rows with repeated or null keys are documents of
    their own (a null key names a group only if the group has no other). Other columns are ignored.
    """
    rows, named = numbered(df.select(F.col(key).alias("_key"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")))
    found, _ = similar_components(rows.select("_row", "text"), n, percent)
    if not named:
        return found.select(F.col("_row").alias(key), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
    found = found.join(rows.select("_row", "_key"), "_row")
    names = found.groupBy("component").agg(F.min("_key").alias("component_id"))
    return found.join(names, "component").select(F.col("_key").alias(key), F.col("size").alias("n_shingles"), "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", column: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without near duplicates: of every group the one of smallest key stays.

    All columns come back as they are. Of equal keys in one group any one row stays; documents
    without words and rows with a null text stay.
    """
    packed = df.select(
        F.struct("*").alias("_document"), F.col(key).alias("_key"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")
    )
    rows, _ = numbered(packed)
    found, _ = similar_components(rows.select("_row", "text"), n, percent)
    gone = materialize(found.filter(F.col("_row") != F.col("component")).select("_row"), "near-duplicates")
    few = gone.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS
    return rows.join(_sent(gone, few), "_row", "left_anti").select("_document.*")
