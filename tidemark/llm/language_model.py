"""N-gram language model as a weighted backoff automaton, built and run over distributed tables.

States are the contexts (none, one word, two words) that training holds at least twice.
An n-gram that training holds is an arc of its context's state; a state without an arc
for the next token follows its failure arc to the shorter context. Absolute discounting
sets the weights: with c the training counts, D the discount and t(h) the number of arcs
of state h,

    arc (h, w):           (c(h w) - D) / c(h)
    failure arc of h:     D t(h) / c(h) / (1 - S(h)),  S(h) = sum of P(w | h') over h's arcs

where h' is h without its first word. The failure arc hands on just the mass that the
arcs leave, so each state's probabilities sum to one over the vocabulary and one unknown
word. The state without a word has the add-0.1 unigrams of the base score.

A text is scored in one left-to-right pass that carries the state: take the arc where
there is one; else pay the failure arc and try again from the shorter state.

Tables are distributed; none is sent to all workers. Texts are written once, in blocks
of tokens. A block asks for what its own states and arcs need, in three exchanges:

1. training counts of its distinct words and word pairs;
2. training counts of the triples that begin with a state, and (t, S) of the states of one word;
3. (t, S) of the states of two words;

and then traverses. The answer to a count marks one block as the owner of an n-gram, and
owners alone add to t and S, so each arc counts once. A block sends each key once, so a
frequent word or pair costs a bucket one entry a block, and the number of buckets follows
the number of blocks, that is the bytes of the input.

Keys are 60-bit hashes: of 10^10 distinct n-grams about 40 share a key with another.

Defined cases: null text is the empty text and holds the end token alone; repeated
rows are scored each for itself; an empty training set gives N = V = 0 and the
uniform base; an empty table gives no rows; a null doc_id is scored like any other;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded, materialize, mix64, partitions, text_bytes

ADD = 0.1
#: Taken off the count of every arc.
DISCOUNT = 0.75
#: A context is a state from so many occurrences on.
STATE = 2
#: Text bytes of a block.
BLOCK_BYTES = 10 << 20
#: Blocks for each bucket of keys.
BLOCKS_PER_BUCKET = 2
#: The end token's hash.
END = np.uint64(0x5851F42D4C957F2D)
KEY_BITS = 60
#: What is asked for: counts of n-grams of one, two and three words; the sums of states of one and of two words.
COUNTS, SUMS = (1, 2, 3), {1: 11, 2: 12}

_BLOCK = "block long, docs binary, null binary, held binary, lens binary, vocab binary, codes binary"
_ASKED = "kind int, bucket int, block long, m long, keys binary, n binary, mass binary"
_ANSWER = "kind int, bucket int, block long, m long, n binary, more binary, distinct long, total long"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers, all first bytes first and compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    width = 8 - int(np.argmax(planes[::-1].any(axis=1))) if len(a) and a.any() else 0
    return bytes([width]) + pa.compress(planes[:width].tobytes(), "zstd", asbytes=True) if width else b"\0"


def _unpack(b: bytes, m: int) -> np.ndarray:
    out = np.zeros((m, 8), np.uint8)
    if b[0]:
        out[:, : b[0]] = np.frombuffer(pa.decompress(b[1:], b[0] * m, "zstd", asbytes=True), np.uint8).reshape(b[0], m).T
    return out.view("<u8").ravel()


def ordered(keys: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Places of the keys in ascending order, equal ones by place.

    The leading bits of a key and its place share a 64-bit number, which sorts many times
    faster than places do; keys that differ only below those bits are rare and sorted anew.
    """
    low = max(1, (len(keys) - 1).bit_length())
    packed = (keys >> np.uint64(max(0, bits + low - 64))) << np.uint64(low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    sorted_ = keys[order]
    return np.argsort(keys, kind="stable") if (sorted_[1:] < sorted_[:-1]).any() else order


def numbered(keys: np.ndarray, bits: int = KEY_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted; a place of each; and for each place the number of its key."""
    order = ordered(keys, bits)
    key = keys[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(first) - 1
    return key[first], order[first], number


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in _names(schema)]
    return pa.table([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, schema.split(", "))], names=_names(schema))


class Block:
    """The tokens of some texts: each text's words, then one end token."""

    def __init__(self, vocab: np.ndarray, codes: np.ndarray, lens: np.ndarray, held: np.ndarray):
        """codes are each token's number in vocab, the hashes of the distinct tokens."""
        self.vocab, self.codes, self.h, self.lens, self.held = vocab, codes, vocab[codes], lens, held
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)

    @classmethod
    def of(cls, texts: list[bytes], held: np.ndarray) -> Block:
        words = Words(texts, lower=True)
        lens = words.count + 1
        h = np.full(int(lens.sum()), END, dtype=np.uint64)
        h[np.arange(len(words.hash)) + np.repeat(np.arange(len(lens)), words.count)] = words.hash
        vocab, _, at = numbered(h, 64)
        by_count = np.argsort(-np.bincount(at, minlength=len(vocab)), kind="stable")  # frequent tokens have small numbers
        rank = np.empty(len(vocab), np.int64)
        rank[by_count] = np.arange(len(vocab))
        return cls(vocab[by_count], rank[at], lens, held)

    @classmethod
    def read(cls, row: dict) -> Block:
        held = np.frombuffer(row["held"], np.uint8).astype(bool)
        lens = _unpack(row["lens"], len(held)).astype(np.int64)
        return cls(np.frombuffer(row["vocab"], np.uint64), _unpack(row["codes"], int(lens.sum())).astype(np.int64), lens, held)


class Grams:
    """The distinct n-grams of one order in a block.

    ``keys`` are sorted; ``last`` is the place of some occurrence's last token; ``id``
    gives the n-gram that ends at each place of the block, -1 where there is none.
    """

    def __init__(self, block: Block, order: int, where: np.ndarray | None = None):
        at = np.flatnonzero(block.place >= order - 1) if where is None else where
        if order == 1:  # the block has its distinct tokens already
            key = mix64(block.vocab) >> np.uint64(64 - KEY_BITS)
            by_key = np.argsort(key)
            rank = np.empty(len(key), np.int64)
            rank[by_key] = np.arange(len(key))
            self.keys, self.id, self.last = key[by_key], rank[block.codes], np.empty(0, np.int64)
        else:
            key = mix64(block.h[at - order + 1])
            for k in range(order - 2, -1, -1):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + block.h[at - k])
            key >>= np.uint64(64 - KEY_BITS)
            self.keys, first, number = numbered(key)
            self.last = at[first]
            self.id = np.full(len(block.codes), -1, dtype=np.int64)
            self.id[at] = number
        self.block, self.at = block, at
        self.count = self.owner = np.empty(0, np.int64)

    def own(self) -> np.ndarray:
        """How often the block's training texts hold each n-gram."""
        taught = self.at[~self.block.held[self.block.doc[self.at]]]
        return np.bincount(self.id[taught], minlength=len(self.keys))

    def __len__(self) -> int:
        return len(self.keys)


def _bucket_edges(u: np.ndarray, n: int) -> np.ndarray:
    """Where each of n key ranges begins in the sorted keys."""
    bucket = ((u >> np.uint64(KEY_BITS - 32)) * np.uint64(n)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))


def _ask(kind: int, block_id: int, keys: np.ndarray, n: np.ndarray, mass: np.ndarray | None, buckets: int) -> list[tuple]:
    """A row for each bucket that any of the sorted keys falls into."""
    edges = _bucket_edges(keys, buckets)
    sent = lambda p, q: None if mass is None else _pack(mass[p:q])
    return [(kind, j, block_id, int(q - p), _pack(np.diff(keys[p:q], prepend=np.uint64(0))), _pack(n[p:q]), sent(p, q)) for j, (p, q) in enumerate(zip(edges[:-1], edges[1:])) if q > p]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about BLOCK_BYTES of text; a longer text stands alone."""
    held, size = [], 0
    for batch in bounded(batches, limit=BLOCK_BYTES // 8):  # small pieces fill a block well
        n = batch.column("text").nbytes
        if held and size + n > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield held


def kept_blocks(source: DataFrame) -> DataFrame:
    """The tokens of each block as one row: word numbers, most frequent first, and the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _gathered(batches):
            t = pa.Table.from_batches(parts)
            docs, held = t.column("doc_id").combine_chunks(), np.array(t.column("held_out").to_pylist(), dtype=bool)
            block = Block.of(text_bytes(t.column("text")), held)
            ids = np.array(docs.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            null = np.array(docs.is_null().to_numpy(zero_copy_only=False), dtype=np.uint8)
            row = (t.column("_row")[0].as_py(), ids.tobytes(), null.tobytes(), held.astype(np.uint8).tobytes(), _pack(block.lens), block.vocab.tobytes(), _pack(block.codes))
            yield from _table(_BLOCK, [row]).to_batches()

    return source.mapInArrow(run, _BLOCK)


def answered(requests: DataFrame) -> DataFrame:
    """For each request, in the order of its keys: training counts and ownership, or the two sums of states.

    One row of a bucket of counts has its distinct n-grams and their sum.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending")])
        kind, sizes = t.column("kind")[0].as_py(), t.column("m").to_pylist()
        column = lambda name: np.concatenate([_unpack(b, m) for b, m in zip(t.column(name).to_pylist(), sizes)]).astype(np.int64)
        keys = np.concatenate([np.cumsum(_unpack(b, m), dtype=np.uint64) for b, m in zip(t.column("keys").to_pylist(), sizes)])
        n = column("n")
        order = ordered(keys)
        u = keys[order]
        first = np.concatenate([[True], u[1:] != u[:-1]])
        group = np.cumsum(first) - 1
        folded = lambda x: np.bincount(group, weights=x[order]).astype(np.int64)
        total, edges, whole = folded(n), np.cumsum([0, *sizes]), [(0, 0)] * len(sizes)
        reply = np.empty(len(keys), np.int64)
        reply[order] = total[group]
        if kind in COUNTS:
            seen = np.cumsum(n[order] > 0)
            before = (seen - (n[order] > 0))[first][group]  # entries of earlier n-grams that training holds
            own = np.zeros(len(keys), bool)
            own[order] = (n[order] > 0) & (seen - before == 1)
            whole[0] = int((total > 0).sum()), int(total.sum())
            second = [np.packbits(own[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        else:
            mass = np.empty(len(keys), np.int64)
            mass[order] = folded(column("mass"))[group]
            second = [_pack(mass[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        columns = zip(t.column("kind").to_pylist(), t.column("bucket").to_pylist(), t.column("block").to_pylist(), sizes)
        return _table(_ANSWER, [(*c, _pack(reply[a:b]), x, *w) for c, a, b, x, w in zip(columns, edges[:-1], edges[1:], second, whole)])

    return requests.groupBy("kind", "bucket").applyInArrow(run, _ANSWER)


class Local:
    """What a block knows of the automaton, from the answers that it has had so far."""

    def __init__(self, block: Block, replies: list[dict], total: int = 0, distinct: int = 0):
        self.block, self.total, self.distinct = block, total, distinct
        self.by_kind: dict[int, list[dict]] = {}
        for r in sorted(replies, key=lambda r: (r["kind"], r["bucket"])):
            self.by_kind.setdefault(r["kind"], []).append(r)
        self.one, self.two = self.counted(1), self.counted(2)
        self.base = (self.one.count + ADD) / (total + ADD * (distinct + 1))
        self.state = {1: self.one.count >= STATE, 2: self.two.count >= STATE}

    def counted(self, order: int, where: np.ndarray | None = None) -> Grams:
        g, rows = Grams(self.block, order, where), self.by_kind.get(order, [])
        g.count = np.concatenate([np.empty(0, np.int64), *(_unpack(r["n"], r["m"]).astype(np.int64) for r in rows)])
        g.owner = np.concatenate([np.empty(0, bool), *(np.unpackbits(np.frombuffer(r["more"], np.uint8), count=r["m"]).astype(bool) for r in rows)])
        return g

    def after_state(self) -> np.ndarray:
        """The places whose two words before are a state."""
        at = np.flatnonzero(self.block.place >= 2)
        return at[self.state[2][self.two.id[at - 1]]] if len(at) else at

    def triples(self) -> Grams:
        return self.counted(3, self.after_state())

    def arc(self, g: Grams, contexts: Grams, states: np.ndarray) -> np.ndarray:
        """The probability of each n-gram's arc, nan where its state or the arc is missing."""
        context = contexts.id[g.last - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(states[context] & (g.count > 0), (g.count - DISCOUNT) / contexts.count[context], np.nan)

    def sums(self, block_id: int, order: int, buckets: int) -> list[tuple]:
        """Asks for the sums of the states of one or two words, with what this block's own arcs add.

        They are t, the number of arcs, and the sum of the counts of the arcs' n-grams without
        their first words: S is linear in the two.
        """
        contexts, g, below = (self.one, self.two, self.one) if order == 1 else (self.two, self.triples(), self.two)
        mine = np.flatnonzero(g.owner)
        context = contexts.id[g.last[mine] - 1]
        mine, context = mine[self.state[order][context]], context[self.state[order][context]]
        t = np.bincount(context, minlength=len(contexts)).astype(np.int64)
        mass = np.bincount(context, weights=below.count[below.id[g.last[mine]]], minlength=len(contexts)).astype(np.int64)
        live = self.state[order]
        return _ask(SUMS[order], block_id, contexts.keys[live], t[live], mass[live], buckets)

    def fail(self, order: int) -> np.ndarray:
        """log10 of the weight of each context's failure arc, nan where it is no state."""
        contexts, out = (self.one, self.two)[order - 1], np.full(len(self.state[order]), np.nan)
        rows = self.by_kind.get(SUMS[order], [])
        t, mass = (np.concatenate([np.empty(0), *(_unpack(r[name], r["m"]).astype(np.float64) for r in rows)]) for name in ("n", "more"))
        live = self.state[order]
        if order == 1:
            s = (mass + ADD * t) / (self.total + ADD * (self.distinct + 1))
        else:  # all arcs of u v lead to words that follow v
            shorter = np.zeros(len(contexts))
            shorter[self.two.id[self.two.last]] = self.one.count[self.one.id[self.two.last]]
            s = (mass - DISCOUNT * t) / shorter[live]
        with np.errstate(divide="ignore"):
            out[live] = np.log10(DISCOUNT * t / contexts.count[live] / np.maximum(1 - s, 1e-15))
        return out


def traverse(local: Local) -> np.ndarray:
    """log10 of the probability of each text: one left-to-right pass in which every text carries its state.

    All texts of the block advance together, the longest first. A state is 0, 1 or 2 words
    of context. Where it has no arc for the token, its failure arc is paid and the shorter
    state tried; the state without words has an arc for every token.
    """
    block, three = local.block, local.triples()
    end = lambda a: np.append(a, np.nan)  # noqa: E731  id -1 is no arc
    with np.errstate(invalid="ignore"):
        root, arc2, arc3 = np.log10(local.base), end(np.log10(local.arc(local.two, local.one, local.state[1]))), end(np.log10(local.arc(three, local.two, local.state[2])))
    fail1, fail2 = local.fail(1), local.fail(2)
    id1, id2, id3 = local.one.id, local.two.id, three.id
    is1, is2 = local.state[1], np.append(local.state[2], False)
    by_length = np.argsort(-block.lens, kind="stable")
    start, lens = (np.cumsum(block.lens) - block.lens)[by_length], block.lens[by_length]
    live = np.searchsorted(-lens, -np.arange(1, (int(lens[0]) if len(lens) else 0) + 1), side="right")
    out, state = np.zeros(len(lens)), np.zeros(len(lens), dtype=np.int8)
    for step, m in enumerate(live.tolist()):
        at, now = start[:m] + step, state[:m].copy()
        cost = np.full(m, np.nan)
        k = np.flatnonzero(now == 2)
        if len(k):
            cost[k] = arc3[id3[at[k]]]
        paid = np.zeros(m)
        k = k[np.isnan(cost[k])]
        if len(k):
            paid[k] = fail2[id2[at[k] - 1]]
            now[k] = 1
        k = np.flatnonzero(now == 1)
        k = k[np.isnan(cost[k])]
        if len(k):
            cost[k] = arc2[id2[at[k]]]
            k = k[np.isnan(cost[k])]
            paid[k] += fail1[id1[at[k] - 1]]
        k = np.flatnonzero(np.isnan(cost))
        cost[k] = root[id1[at[k]]]
        out[:m] += paid + cost
        state[:m] = np.where(is2[id2[at]], 2, is1[id1[at]])
    total = np.empty(len(lens))
    total[by_length] = out
    return total


def _asking(blocks: DataFrame, answers: list[DataFrame], ask, schema: str) -> DataFrame:
    """ask(block id, its row, its replies) gives a table, for each block with all it has been told."""
    told = answers[0].drop("distinct", "total")
    for a in answers[1:]:
        told = told.unionByName(a.drop("distinct", "total"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        return ask(row["block"], row, right.to_pylist())

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; held-out rows do not train."""
    spark = docs.sparkSession
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = materialize(kept_blocks(source), "lm-blocks")
    n = max(partitions(spark), -(-blocks.count() // BLOCKS_PER_BUCKET))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                for k in (1, 2):
                    g = Grams(block, k)
                    yield from _table(_ASKED, _ask(k, row["block"], g.keys, g.own(), None, n)).to_batches()

    counts = materialize(answered(blocks.mapInArrow(first, _ASKED)), "lm-counts")
    distinct, total = counts.filter("kind = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def second(block_id: int, row: dict, replies: list[dict]) -> pa.Table:
        local = Local(Block.read(row), replies, total, distinct)
        g = Grams(local.block, 3, local.after_state())
        return _table(_ASKED, [*_ask(3, block_id, g.keys, g.own(), None, n), *local.sums(block_id, 1, n)])

    triples = materialize(answered(_asking(blocks, [counts], second, _ASKED)), "lm-triples")

    def third(block_id: int, row: dict, replies: list[dict]) -> pa.Table:
        return _table(_ASKED, Local(Block.read(row), replies, total, distinct).sums(block_id, 2, n))

    sums = materialize(answered(_asking(blocks, [counts, triples.filter("kind = 3")], third, _ASKED)), "lm-sums")

    def last(block_id: int, row: dict, replies: list[dict]) -> pa.Table:
        local = Local(Block.read(row), replies, total, distinct)
        block = local.block
        add = lambda w: np.bincount(block.doc, weights=w, minlength=len(block.lens))
        known, base = add(local.one.count[local.one.id] > 0).astype(np.int64), add(np.log10(local.base)[local.one.id])
        ids = pa.array(np.frombuffer(row["docs"], np.int64), mask=np.frombuffer(row["null"], np.uint8).astype(bool))
        columns = [ids, pa.array(block.held), pa.array(block.lens), pa.array(known), pa.array(np.full(len(block.lens), total, np.int64)), pa.array(base), pa.array(traverse(local))]
        return pa.table(columns, names=_names(_SCORE))

    return _asking(blocks, [counts, triples, sums], last, _SCORE)
