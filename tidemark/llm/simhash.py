"""SimHash fingerprints and bit-sliced near-duplicate search.

Fingerprints are taken from word shingles; equal fingerprints are folded before
any search. Two fingerprints within ``radius`` bits that are cut into ``blocks``
pieces agree wholly on at least ``blocks - radius`` of them (pigeonhole), so each
choice of that many blocks is a table whose key holds the blocks' bits: exact, with
no candidate lost. The number of blocks grows with the number of fingerprints, so
that a key stays selective.

Inside a key the fingerprints stand as bit planes: plane j holds bit j of 64
fingerprints in one word. A query is XORed plane by plane and added into
carry-save counters (sum planes up to the radius and a sticky overflow plane), which updates
64 distances with a few word operations; a block of planes is abandoned once every
lane is over the radius.

A key with many fingerprints is split into tiles; the tiles of one key are compared
pair by pair, each pair in its own group of bounded size. Of each group's links only the
trees that they form are kept, each member with its root, so output is linear in the fingerprints.

Texts of a given Jaccard similarity lie further apart than 4 of 64 bits. keep_similar()
therefore takes 256-bit fingerprints of five-word shingles and the radius that pairs of
similarity 0.8 rarely exceed. Pigeonhole tables don't reach so far; its tables sample bits,
as many tables as the recall asks for, and the same bit-sliced comparison decides.

Defined cases: null text is the empty text; a text without words has fingerprint
zero and links like any other; a text shorter than a shingle is one shingle;
repeated rows share their component; null doc_ids form components but are never
chosen as component id unless nothing else is there; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded, free_name, materialize, mix64, text_bytes
from .components import connected_components

BITS = 64
#: Fingerprints of one tile; two tiles are the most that one comparison holds.
TILE = 8192
#: Fingerprints expected under one key of a table, at most.
PER_KEY = 64


def fingerprint(text: bytes, words: int = 4) -> int:
    """Majority of the bits of XXH64 (seed 42) over all word shingles, as a signed 64-bit number."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        h = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = [0, *ends[:-words].tolist()]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (signed 64-bit) and row_key, a hash of doc_id and text, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            fps = [fingerprint(t, words) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64()), batch.column("row_key")], ["doc_id", "fp", "row_key"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row_key"))
    return source.mapInArrow(run, "doc_id long, fp long, row_key long")


def row_key() -> Column:
    """Tells rows apart by doc_id and text; wholly equal rows share it."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text").cast("string"))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(bits, words) bit planes of fingerprints (n,) or (n, W) of uint64; lanes past the end repeat the last one."""
    fps = fps.reshape(len(fps), -1)
    lanes = np.concatenate([fps, np.repeat(fps[-1:], -len(fps) % 64, axis=0)])
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, radius: int, want: np.ndarray | None = None, check_every: int = 8) -> np.ndarray:
    """Lane masks (queries, words) of the wanted lanes whose fingerprints are within radius of each query.

    queries is (q,) or (q, W); planes is (64 W, words), shared by all queries, or (64 W, q, words),
    each query's own. want holds the lanes (q, words) to look at, all if None.
    """
    queries = queries.reshape(len(queries), -1)
    own = planes.ndim == 3
    q, w = len(queries), planes.shape[-1]
    if want is None:
        want = np.full((q, w), ~np.uint64(0))
    sums = [np.zeros((q, w), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros((q, w), dtype=np.uint64)
    alive = np.arange(q)
    out = np.zeros((q, w), dtype=np.uint64)

    def too_far() -> np.ndarray:
        # lanes whose count (the overflow plane, then the sum planes) is above the radius
        above, equal = over.copy(), ~over
        for i in reversed(range(len(sums))):
            if radius >> i & 1:
                equal &= sums[i]
            else:
                above |= equal & sums[i]
                equal &= ~sums[i]
        return above

    for j in range(len(planes)):
        flip = np.where((queries[alive, j // 64] >> np.uint64(j % 64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))[:, None]
        carry = (planes[j][alive] if own else planes[j][None, :]) ^ flip
        for i, plane in enumerate(sums):
            sums[i], carry = plane ^ carry, plane & carry
        over |= carry
        if j % check_every == check_every - 1 and j >= radius and j < len(planes) - 1:
            live = (~too_far() & want[alive]).any(axis=1)  # a query's block is abandoned once all its lanes are too far
            if not live.all():
                alive, over, sums = alive[live], over[live], [x[live] for x in sums]
                if not len(alive):
                    return out
    out[alive] = ~too_far() & want[alive]
    return out


def _lanes(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) of every set bit."""
    rows, words = np.nonzero(masks)
    bits = np.unpackbits(masks[rows, words].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, lane = np.nonzero(bits)
    return rows[r], words[r] * 64 + lane


def _between(first: np.ndarray, stop: np.ndarray, words: int) -> np.ndarray:
    """Lane masks (rows, words) with the lanes first <= lane < stop of each row set."""

    def below(n: np.ndarray) -> np.ndarray:
        n = np.clip(n[:, None] - 64 * np.arange(words)[None, :], 0, 64)
        return np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n & 63).astype(np.uint64)) - np.uint64(1))

    return below(stop) & ~below(first)


class Forest:
    """Union-find over 0..n-1; a tree's root is its least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] and b[i]: the least root spreads along the links until nothing changes."""
        while True:
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b, least = a[apart], b[apart], np.minimum(x[apart], y[apart])
            np.minimum.at(self.parent, np.maximum(x[apart], y[apart]), least)
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Every member that is no root, and its root."""
        at = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return at, self.parent[at]


def link_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and roots of what the links inside left and, if given, between left and right connect."""
    both = left if right is None else np.concatenate([left, right])
    planes = planes_of(both)
    forest = Forest(len(both))
    step = max(1, (1 << 13) // planes.shape[1])
    for at in range(0, len(left), step):
        part = left[at : at + step]
        index = np.arange(at, at + len(part))
        a, b = _lanes(within(part, planes, radius, _between(index + 1, np.full(len(part), len(both)), planes.shape[1])))
        forest.add(a + at, b)
    return forest.stars()


def small_links(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, lanes: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Members and roots, as positions, of what the links connect inside groups of at most ``lanes`` fingerprints; a group's planes take lanes / 64 words."""
    fps = fps.reshape(len(fps), -1)
    forest = Forest(len(fps))
    step = max(1, (1 << 18) // (fps.shape[1] * lanes * 4))
    for at in range(0, len(starts), step):
        start, size = starts[at : at + step], sizes[at : at + step]
        index = start[:, None] + np.minimum(np.arange(lanes)[None, :], size[:, None] - 1)
        bits = np.unpackbits(fps[index].astype("<u8").view(np.uint8).reshape(len(start), lanes, -1), axis=2, bitorder="little")
        planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")
        group = np.repeat(np.arange(len(start)), size)
        member = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        for m in range(0, len(group), 1 << 13):
            g, k = group[m : m + (1 << 13)], member[m : m + (1 << 13)]
            row, lane = _lanes(within(fps[start[g] + k], planes[:, g, :], radius, _between(k + 1, size[g], lanes // 64)))
            forest.add(start[g[row]] + k[row], start[g[row]] + lane)
    return forest.stars()


def block_masks(n_blocks: int, radius: int) -> list[tuple[int]]:
    """Bit masks of the tables: every choice of n_blocks - radius of the blocks."""
    edges = [round(i * BITS / n_blocks) for i in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [(sum(c),) for c in combinations(blocks, n_blocks - radius)]


def choose_blocks(n: int, radius: int) -> int:
    """The fewest blocks with which a random key holds at most PER_KEY of n fingerprints."""
    blocks = radius + 2
    while n >> int(BITS * (blocks - radius) / blocks) > PER_KEY and blocks < 3 * (radius + 1):
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int, masks: list[tuple[int, ...]], words: tuple[str, ...] = ("fp",), node: str = "fp", sparse: bool = True) -> DataFrame:
    """(u, v): each node with the least one that links within radius connect it to among those that share a table's key.

    A group gives less than one row a node, and the same rows in every table that holds it whole.

    words are the columns of the fingerprint; sparse says that most keys hold one fingerprint, which are then left out before the exchange.
    """
    columns = list(dict.fromkeys([node, *words]))
    part = lambda w, m: F.col(w).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))
    keys = F.array(*[F.xxhash64(F.lit(t), *[part(w, m) for w, m in zip(words, mask)]) for t, mask in enumerate(masks)])
    keyed = distinct.select(*columns, F.explode(keys).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if sparse:
        dealt = keyed.join(materialize(counts.filter("n > 1"), "shared-keys"), "key")  # written, so that Spark can split a hot key
    else:  # few keys are so large that they are cut into tiles; written, so that Spark knows how few
        dealt = keyed.join(materialize(counts.filter(F.col("n") > TILE), "large-keys"), "key", "left")
    dealt = dealt.withColumn("tiles", F.expr(f"cast(1 + coalesce(n - 1, 0) div {TILE} as int)"))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64(node), F.col("tiles")).cast("int"))
    # a row goes to every pair of tiles that holds its own tile: the pair (i, j), i <= j
    pair = F.expr("transform(sequence(0, tiles - 1), x -> struct(least(x, tile) as i, greatest(x, tile) as j))")
    dealt = dealt.select(*columns, "key", "tile", F.explode(pair).alias("p"))
    side = F.when((F.col("p.i") == F.col("p.j")) | (F.col("tile") == F.col("p.i")), 0).otherwise(1).cast("long")
    rows = dealt.select(F.xxhash64("key", "p.i", "p.j").alias("g"), side.alias("side"), *columns)
    at = [2 + columns.index(w) for w in words]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= 1 << 16:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero(rows[0] != rows[0, -1])
                cut = int(last[-1]) + 1 if len(last) else 0
                held = [rows[:, cut:]]
                if cut:
                    yield _links_of(rows[:, :cut], at, radius)
        if held:
            yield _links_of(np.concatenate(held, axis=1), at, radius)

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "g").sortWithinPartitions("g", node).mapInArrow(compare, "u long, v long")


def _links_of(rows: np.ndarray, words: list[int], radius: int) -> pa.RecordBatch:
    """What the links connect in consecutive whole groups (g, side, node, ...); words are the rows that hold the fingerprint."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]])
    starts, sizes = edges[:-1], np.diff(edges)
    fp = np.ascontiguousarray(rows[words].T).view(np.uint64)
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for least, lanes in ((1, 64), (64, 256)):
        small = (sizes > least) & (sizes <= lanes)
        if small.any():
            a, b = small_links(fp, starts[small], sizes[small], radius, lanes)
            u.append(rows[2][a])
            v.append(rows[2][b])
    for k in np.flatnonzero(sizes > 256).tolist():
        part, nodes, side = fp[edges[k] : edges[k + 1]], rows[2, edges[k] : edges[k + 1]], rows[1, edges[k] : edges[k + 1]]
        left, right = part[side == 0], part[side == 1]
        if len(left):
            both = np.concatenate([nodes[side == 0], nodes[side == 1]])
            a, b = link_forest(left, right if len(right) else None, radius)
            u.append(both[a])
            v.append(both[b])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """doc_id, row_key, fp, component_id and n_equal, the rows of the same fingerprint, of every row."""
    if not 0 <= radius < BITS // 2:
        raise ValueError("a radius of half the bits or more links anything")
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_equal")), "distinct-fingerprints")
    roots = connected_components(links(distinct, radius, block_masks(choose_blocks(distinct.count(), radius), radius)))
    named = materialize(distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    # written first: with an exchange on either side Spark can split the rows of a large component
    ids = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    classes = named.join(ids, "root").select("fp", "component_id", "n_equal")
    return rows.join(classes, "fp").select("doc_id", "row_key", "fp", "component_id", "n_equal")


#: 64-bit numbers of a wide fingerprint.
WIDE = 4
_WIDE = [f"f{i}" for i in range(WIDE)]


def wide_fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """(texts, WIDE) fingerprints of word shingles, repeats included; a bit that half the shingles set is that of the first."""
    found = Words(texts, lower=True)
    n = found.count
    place = np.arange(len(found.hash)) - np.repeat(np.cumsum(n) - n, n)
    size = np.repeat(n, n)
    at = np.flatnonzero(place <= np.maximum(size - words, 0))
    h = np.zeros(len(at), dtype=np.uint64)
    padded = np.append(found.hash, np.zeros(words, np.uint64))
    for j in range(words):
        h = mix64(h + np.where(place[at] + j < size[at], padded[at + j], np.uint64(0)))
    doc = np.repeat(np.arange(len(texts)), n)[at]
    total = np.bincount(doc, minlength=len(texts))
    salts = mix64(np.arange(1, WIDE + 1, dtype=np.uint64))
    some = np.flatnonzero(total)
    begin = np.cumsum(total)[some] - total[some]
    # one bit of each byte is counted at a time, in the eight bytes of a word: at most 255 shingles at once
    cut = np.flatnonzero(place[at] % 255 == 0)
    ones = np.empty((len(some), WIDE, 8, 8), dtype=np.int64)
    first = np.empty((len(some), WIDE), dtype=np.uint64)
    for k in range(WIDE if len(some) else 0):
        x = mix64(h ^ salts[k])
        first[:, k] = x[begin]
        for i in range(8):
            part = np.add.reduceat((x >> np.uint64(i)) & np.uint64(0x0101010101010101), cut)
            ones[:, k, :, i] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8), np.searchsorted(cut, begin), axis=0, dtype=np.int64)
    first = np.unpackbits(first.view(np.uint8).reshape(len(some), 8 * WIDE), axis=1, bitorder="little")
    twice, n = 2 * ones.reshape(len(some), 64 * WIDE), total[some, None]
    out = np.zeros((len(texts), 8 * WIDE), dtype=np.uint8)
    out[some] = np.packbits((twice > n) | ((twice == n) & (first > 0)), axis=1, bitorder="little")
    return out.view("<u8")


def differing_share(similarity: float) -> float:
    """Share of fingerprint bits in which two texts of equally many shingles with this Jaccard similarity differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_for(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits within which 19 of 20 pairs of just that similarity lie; nearly all of a higher one."""
    p = differing_share(similarity)
    return int(bits * p + 1.645 * math.sqrt(bits * p * (1 - p)))


def sampled_masks(n: int, similarity: float, recall: float) -> list[tuple[int, ...]]:
    """Masks of sampled bits: a random key holds at most PER_KEY of n fingerprints, and a pair of just
    that similarity shares a key of some table with probability ``recall``."""
    k = max(8, math.ceil(math.log2(max(1, n / PER_KEY))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing_share(similarity)) ** k))
    rng = np.random.default_rng(11)
    chosen = [rng.choice(64 * WIDE, size=k, replace=False).tolist() for _ in range(tables)]
    return [tuple(sum(1 << (b % 64) for b in bits if b // 64 == w) for w in range(WIDE)) for bits in chosen]


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, recall: float = 0.99) -> DataFrame:
    """doc_id, row_key and root, the same for all rows linked by wide fingerprints within radius_for(similarity).

    Equal fingerprints are folded; tables of sampled bits give the candidates, bit-sliced
    comparison of all 256 bits decides. Candidates of one key are never written as pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            fps = wide_fingerprints(text_bytes(batch.column("text")), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *(pa.array(fps[:, i]) for i in range(WIDE))], ["doc_id", "row_key", *_WIDE])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row_key"))
    rows = materialize(source.mapInArrow(run, "doc_id long, row_key long, " + ", ".join(f"{f} long" for f in _WIDE)), "wide-fingerprints")
    distinct = materialize(rows.select(*_WIDE).distinct().withColumn("node", F.monotonically_increasing_id()), "distinct-fingerprints")
    masks = sampled_masks(distinct.count(), similarity, recall)
    roots = connected_components(links(distinct, radius_for(similarity), masks, tuple(_WIDE), "node", sparse=False))
    named = distinct.join(roots.withColumnRenamed("v", "node"), "node", "left").select(*_WIDE, F.coalesce("root", "node").alias("root"))
    return rows.join(materialize(named, "roots"), _WIDE).select("doc_id", "row_key", "root")


def keep_similar(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """docs with one row of each group of similar texts: that of the least doc_id, of its rows the one with the least key.

    Rows without a doc_id stay only where their group has no other; rows wholly equal in
    doc_id and text count once; null and wordless texts are one group; an empty table stays empty.
    """
    found = materialize(similar_groups(docs, similarity, words), "similar-groups")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("row_key").alias("k")))
    return _with_keys(docs, found, found.groupBy("root").agg(first.alias("p")).select(F.col("p.k").alias("k")))


def _with_keys(docs: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose row_key() is among kept.k, each key once."""
    key = free_name(docs, "near_key")
    out = docs.withColumn(key, row_key()).join(kept.select(F.col("k").alias(key)), key, "left_semi")
    if not found.groupBy("row_key").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([key])
    return out.select(docs.columns)


def keep_one(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, and of its rows the one with the least key."""
    found = materialize(near_duplicates(docs, radius, words), "near-duplicates")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("row_key").alias("k")))
    # a component without any doc_id has a null component_id; its rows are told apart by fingerprint
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("g")]
    return _with_keys(docs, found, found.groupBy(*group).agg(first.alias("p")).select(F.col("p.k").alias("k")))
