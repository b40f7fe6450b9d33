"""The exact nearest rows of sparse vectors, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows of one block; a task holds one block of each.
QUERY_BLOCK, ROW_BLOCK = 4096, 2048
#: Pairs whose similarities are held at a time.
PAIRS = 1 << 20
_SCHEMA = "q long, d long, sim double, rank_sim double"


def _postings(words: int, entries: np.ndarray, x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word's entries begin, and the owners and weights of the entries in the order of their words."""
    order = np.argsort(entries, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(entries, minlength=words))])
    return begin, owner[order], x[order]


def _flat(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """ids, words, weights, entries a row and lengths of a table, by rising id."""
    table = table.sort_by("id").combine_chunks()
    words, x = (table.column(c).combine_chunks() for c in ("words", "x"))
    count = words.value_lengths().to_numpy(zero_copy_only=False)
    return table.column("id").to_numpy(), words.flatten(), x.flatten().to_numpy(zero_copy_only=False), count, table.column("size").to_numpy()


def _scores(codes: np.ndarray, x: np.ndarray, begin: np.ndarray, owner: np.ndarray, weight: np.ndarray, queries: int) -> np.ndarray:
    """The dot products of one row and all queries; codes are the row's words as places in begin, -1 for words of no query."""
    known = codes >= 0
    codes, x = codes[known], x[known]
    n = begin[codes + 1] - begin[codes]
    at = np.arange(n.sum()) + np.repeat(begin[codes] - (np.cumsum(n) - n), n)
    return np.bincount(owner[at], np.repeat(x, n) * weight[at], queries)


def best_of_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, by similarity of nine digits, then the least id; rows without a shared word don't count."""
    ids, words, weight, count, size = _flat(queries)
    known = words.dictionary_encode()
    begin, owner, weight = _postings(len(known.dictionary), known.indices.to_numpy(), weight, np.repeat(np.arange(len(ids)), count))
    d_ids, d_words, d_x, d_count, d_size = _flat(rows)
    codes = pc.index_in(d_words, known.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(d_count)])
    best = np.zeros((k, len(ids)))
    who, exact = np.full((k, len(ids)), -1), np.zeros((k, len(ids)))
    step = max(1, PAIRS // len(ids))
    for a in range(0, len(d_ids), step):
        b = min(a + step, len(d_ids))
        s = np.zeros((b - a, len(ids)))
        for i in range(a, b):
            e = slice(ends[i], ends[i + 1])
            s[i - a] = _scores(codes[e], d_x[e], begin, owner, weight, len(ids))
        s /= d_size[a:b, None] * size[None, :]
        s[d_ids[a:b, None] == ids[None, :]] = 0.0
        # rows come by rising id, and argmax takes the first of equals
        sims, rounded, name = np.concatenate([exact, s]), np.concatenate([best, np.round(s, 9)]), np.concatenate([who, np.broadcast_to(np.arange(a, b)[:, None], s.shape)])
        rounded[sims <= 0] = -1.0
        column = np.arange(len(ids))
        for j in range(k):
            top = rounded.argmax(axis=0)
            best[j], who[j], exact[j] = rounded[top, column], name[top, column], sims[top, column]
            rounded[top, column] = -2.0
        exact[best < 0] = 0.0
    found = best >= 0
    return pa.table({"q": np.broadcast_to(ids, found.shape)[found], "d": d_ids[who[found]], "sim": exact[found], "rank_sim": best[found]})


def nearest(vectors: DataFrame, queries: DataFrame, n_vectors: int, n_queries: int, k: int) -> DataFrame:
    """(q, d, sim, rank_sim): for each query the k best other rows of each block, by cosine; its best k are among them.

    Both inputs are (id, words, x, size): words and their weights as arrays, and the vector's length; ids are unique.
    Every pair is looked at, in blocks: a task holds one block of queries and one of
    rows, and only a block's best leave it. So nothing a pair is shuffled; queries are
    copied once a block of rows, rows once a block of queries.
    """
    nq, nd = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_vectors // ROW_BLOCK))
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", block(nq, 1)).withColumn("db", every(nd))
    d = vectors.withColumn("db", block(nd, 2)).withColumn("qb", every(nq))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "d": pa.array([], pa.int64()), "sim": pa.array([], pa.float64()), "rank_sim": pa.array([], pa.float64())})
        return best_of_block(left, right, k)

    return q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(run, _SCHEMA)
