"""Finds edited copies of benchmark items in documents by CGK embedding and LSH.

Symbols are words (lower-cased runs of letters and digits). A document region is
reported for an item if its word edit distance is at most
``floor((1 - similarity) * item words)``.

1. Embedding. A CGK walk (Chakraborty, Goldenberg, Koucky 2016) from a place in a text
   emits the word under its pointer, and a random bit of (step, word) decides whether
   the pointer moves on. Texts that agree again after an edit walk alike again, so edit
   distance becomes Hamming distance between walks. A window's embedding is the walks
   from all of its places, so windows of every item's size share the walks of a text.
2. LSH. Each of ``repeats`` walks is sampled at two of its steps; the two words are its key.
   The keys of the items' places are in one table. A key that a text shares with an
   item names a window of the item's size, by the diagonal.
3. Recall. Edited windows of each size are simulated with the same walks: the repeats
   grow until nearly all of them share a key with their original, and a window becomes a
   candidate from as many keys on as all but 1 - recall of the simulated ones have.
4. Candidates are verified: every word that is missing costs an edit, then the least
   edit distance of the item to any region around the window is worked out exactly.

Nothing but shared keys makes a candidate. The benchmark is broadcast in blocks of bounded
size, made ready once; documents are scanned once per block and nothing is shuffled.

Defined cases: null or wordless texts and items match nothing; an item of fewer
than five words allows no edits and is found by walks that always move on; of several
regions of a document that hold one item the one with the fewest edits, then the first,
is reported; repeated document rows report each for itself; other columns of the input
are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

FOUND = "doc_id long, item_id long, start_word long, n_words long, edits long, item_words long"
_KINDS = [pa.int64()] * 6
#: Steps of a walk; a copy's words after an edit are met again within so many.
STEPS = 4
LEAST_REPEATS, MOST_REPEATS = 4, 16
#: Bits of the table that tells most keys of a text apart from all keys of the items.
MARK_BITS = 20
#: Items of one broadcast block hold at most this many bytes of text; a longer item stands alone.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def allowed_edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9) if n >= 5 else 0


class Walks:
    """CGK walks of STEPS steps over word numbers below ``size``; -1 is any other word.

    bits[r, j, word] tells whether walk r moves on at step j. Keys are pairs of words: the
    first and the last that a walk emits, where it has moved at all.
    """

    def __init__(self, repeats: int, size: int, seed: int = 7):
        self.repeats, self.size = repeats, size
        self.bits = np.random.default_rng([seed, size]).integers(0, 2, size=(MOST_REPEATS, STEPS - 1, size + 1), dtype=np.int8)[:repeats]

    def keys(self, ids: np.ndarray, at: np.ndarray, walks: range | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``at`` whose walks have a key, and the keys; walk ``repeats`` always moves on by one word."""
        padded = np.concatenate([ids, np.full(STEPS, -1, dtype=ids.dtype)])
        places, keys = [], []
        first = ids[at]
        for r in range(self.repeats) if walks is None else walks:
            where = at + 1
            if r < self.repeats:
                where = at
                for j in range(STEPS - 1):
                    where = where + self.bits[r, j][padded[where]]
            last = padded[where]
            good = np.flatnonzero((where > at) & (last >= 0) & (first >= 0))
            places.append(at[good])
            keys.append((first[good] * self.size + last[good]) * (self.repeats + 1) + r)
        return np.concatenate(places), np.concatenate(keys)


def _simulated(n: int, edits: int, repeats: int, trials: int = 200, draws: int = 10) -> np.ndarray:
    """Keys that windows of n distinct words share with themselves after random edits, on diagonals that so many edits reach."""
    rng, base, out = np.random.default_rng([5, n]), np.arange(n), np.zeros(trials, dtype=np.int64)
    for k in range(trials):
        if k % (trials // draws) == 0:  # other random bits, as items have other words
            walks = Walks(repeats, n, seed=k)
            at, keys = walks.keys(base, base)
            place = dict(zip(keys.tolist(), at.tolist()))
        w = base.tolist()
        for _ in range(edits):
            i, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[i : i + (kind != 1)] = [] if kind == 2 and len(w) > 1 else [-1]
        ids = np.array(w)
        at, keys = walks.keys(ids, np.flatnonzero(ids >= 0))
        out[k] = sum(abs(p - place[x]) <= edits for p, x in zip(at.tolist(), keys.tolist()) if x in place)
    return out


def plan_walks(sizes: dict[int, int], recall: float) -> tuple[int, dict[int, int]]:
    """The repeats for windows of these sizes (words: edits), and how many shared keys make each a candidate."""
    repeats = LEAST_REPEATS
    edited = {n: t for n, t in sizes.items() if t}
    while True:
        shared = {n: _simulated(n, t, repeats) for n, t in edited.items()}
        if repeats >= MOST_REPEATS or all((x > 0).mean() >= recall for x in shared.values()):
            return repeats, {n: max(1, int(np.quantile(x, (1 - recall) / 2, method="lower"))) for n, x in shared.items()}
        repeats += 2


def _symbols(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) | 1 for w in words], dtype=np.uint64)


def best_region(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to any region of text: (edits, start, end); earliest end, then earliest start, win ties."""
    one = np.int64(1) << 32  # a cell holds the cost in its high half, the region's start in its low half
    m = len(text)
    across = np.arange(m + 1) * one
    cell = np.arange(m + 1)
    for i, w in enumerate(item.tolist(), 1):
        new = np.empty_like(cell)
        new[0] = i * one
        np.minimum(cell[:-1] + np.where(text == w, 0, one), cell[1:] + one, out=new[1:])
        cell = np.minimum.accumulate(new - across) + across  # inserted words continue the region to their left
    end = int((cell >> 32).argmin())
    return int(cell[end] >> 32), int(cell[end] & (one - 1)), end


class Matcher:
    """One block of items, ready to scan documents."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        self.single: dict[int, list[int]] = defaultdict(list)
        texts = [(i, w) for i, t in items if (w := words_of(t))]
        for _, w in texts:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        sizes = {len(w): allowed_edits(len(w), similarity) for _, w in texts}
        repeats, need = plan_walks(sizes, recall)
        self.walks = Walks(repeats, max(1, len(self.vocabulary)))
        self.length, self.edits, self.need = [], [], []
        keys, owner, place = [], [], []
        for item_id, w in texts:
            k, t = len(self.items), sizes[len(w)]
            self.items.append((item_id, _symbols(w), t))
            ids = np.array([self.vocabulary[x] for x in w], dtype=np.int64)
            at, mine = self.walks.keys(ids, np.arange(len(ids)), None if t else range(repeats, repeats + 1))
            if len(w) == 1:
                self.single[int(ids[0])].append(k)
            keys, owner, place = [*keys, mine], [*owner, np.full(len(mine), k)], [*place, at]
            self.length.append(len(w))
            self.edits.append(t)
            self.need.append(need[len(w)] if t else max(1, len(mine)))
        self.length, self.edits, self.need = (np.array(x, dtype=np.int64) for x in (self.length, self.edits, self.need))
        self._sets: dict[int, set[int]] = {}
        key, owner, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, owner, place))
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.seed_from = np.append(first, len(order))
        self.seed_item, self.seed_at = owner[order], place[order]
        self.short = bool(((self.edits == 0) & (self.length > 1)).any())
        self.marks = np.zeros(1 << MARK_BITS, dtype=bool)
        self.marks[self._mark(self.keys)] = True

    @staticmethod
    def _mark(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MARK_BITS)).astype(np.int64)

    def candidates(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, first word) of the windows that share enough keys with the item of their size."""
        at, keys = self.walks.keys(ids, np.flatnonzero(ids >= 0), range(self.walks.repeats + self.short))
        near = np.flatnonzero(self.marks[self._mark(keys)])
        at, keys = at[near], keys[near]
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[slot] == keys)
        at, slot = at[hit], slot[hit]
        # every shared key votes for its item on its diagonal; edits move the keys of a copy by at most as many diagonals
        n_seeds = np.diff(self.seed_from)[slot]
        seed = np.repeat(self.seed_from[slot] - (np.cumsum(n_seeds) - n_seeds), n_seeds) + np.arange(n_seeds.sum())
        item = self.seed_item[seed]
        diagonal = np.repeat(at, n_seeds) - self.seed_at[seed]
        axis = item * (1 << 40) + diagonal + (1 << 30)
        votes = np.sort(axis)
        shared = np.searchsorted(votes, axis + self.edits[item], "right") - np.searchsorted(votes, axis - self.edits[item])
        good = shared >= self.need[item]
        return set(zip(item[good].tolist(), diagonal[good].tolist()))

    def scan(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, start_word, n_words, edits, item_words) of each item found."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """scan() of each text. All texts are walked as one sequence, with other words between them."""
        words = [words_of(t) for t in texts]
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        if not self.vocabulary:
            return out
        get, gap = self.vocabulary.get, [-1] * STEPS
        ids = np.array([i for w in words for i in (*[get(x, -1) for x in w], *gap)], dtype=np.int64)
        size = np.array([len(w) for w in words], dtype=np.int64)
        first = np.cumsum(size + STEPS) - size - STEPS
        if self.single:
            lone = np.flatnonzero(np.isin(ids, list(self.single)))
            doc = np.searchsorted(first, lone, "right") - 1
            for i in np.unique(ids[lone] * len(texts) + doc, return_index=True)[1].tolist():  # its first place in each text
                out[doc[i]] += [(self.items[k][0], int(lone[i] - first[doc[i]]), 1, 0, 1) for k in self.single[int(ids[lone[i]])]]
        if not len(self.keys):
            return [sorted(x) for x in out]
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, s in self.candidates(ids):
            middle = s + self.length[k] // 2  # a window may stand out over the ends of its text
            for d in {int(np.searchsorted(first, x, "right")) - 1 for x in (s, middle, s + self.length[k] - 1)}:
                if d >= 0:
                    found[d].append((k, s - int(first[d])))
        for d, windows in found.items():
            out[d] = sorted(out[d] + self.verified(words[d], sorted(windows)))
        return out

    def verified(self, words: list[str], windows: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """The best region of each item that some window around has within the item's edits."""
        symbols = _symbols(words)
        best: dict[int, tuple[int, int, int]] = {}
        for k, s in windows:
            _, item, edits = self.items[k]
            lo, hi = max(0, s - edits), min(len(symbols), s + len(item) + edits)
            if k in best and best[k][0] == 0 or hi <= lo:
                continue
            if k not in self._sets:
                self._sets[k] = set(item.tolist())
            if len(self._sets[k]) - len(self._sets[k].intersection(symbols[lo:hi].tolist())) > edits:
                continue  # every distinct word that is missing costs an edit
            d, a, b = best_region(item, symbols[lo:hi])
            if d <= edits and (k not in best or (d, lo + a) < best[k][:2]):
                best[k] = (d, lo + a, b - a)
        return [(self.items[k][0], a, m, d, len(self.items[k][1])) for k, (d, a, m) in best.items()]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded bytes; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct().toLocalIterator():
        n = len(r["text"].encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row per document row and benchmark item that it holds."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(Matcher(block, similarity, recall))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = sent.value
            for batch in bounded(batches):
                rows = [(d, *r) for d, found in zip(batch.column("doc_id").to_pylist(), matcher.scan_all(batch.column("text").to_pylist())) for r in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [f.split()[0] for f in FOUND.split(", ")])

        part = source.mapInArrow(scan, FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    return found.withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """docs without the rows that hold a benchmark item; each row's own text decides, whatever its doc_id."""
    kept = docs
    for block in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Matcher(block, similarity, recall))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = sent.value
            for batch in bounded(batches):
                yield batch.filter(pa.array([not found for found in matcher.scan_all(batch.column("text").cast(pa.string()).to_pylist())]))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
