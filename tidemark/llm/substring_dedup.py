"""Removes repeated word windows, found through a sampled de Bruijn graph.

A window of WINDOW words is removed if the same words also start in a document of
smaller doc_id.

* Nodes are anchors: of each window's token k-mers the one with the least hash, so
  equal windows have equal anchors and only a small share of all places is kept.
  Edges are the word runs between neighbouring anchors (token k-mers of variable
  length, with the document's beginning and end as further marks).
* A repeated node (in two documents or more) is plain if all its occurrences have the
  same edge in and the same edge out. Plain nodes that follow one another compact to
  one path, found by joining the nodes with their places in the least document that
  has them: the path's source. The path stands whole wherever its first node does, so
  each occurrence of a path is one row, however many nodes and edges it has.
* Between nodes that branch, repeated edges get a source of their own.
* In each document, paths and edges whose source coordinates lie on one diagonal of
  the same source and overlap form a span: its words stand in the source as one run.
  All windows inside a span are settled; the interior of a path is never looked at again.
* Windows that stick out of a path, and those at branching nodes, may repeat in
  documents other than the source. Those outside of spans are compared one by one, by
  64-bit hashes of the window, per node.
* A window with a period of PERIOD words or less equals every window of its run that lies
  whole periods further on. Such windows have no anchors: a run of any length gives a row for
  each of its distinct windows, compared by 64-bit hashes, and an edge reaches over it.

Equality is that of 64-bit hashes throughout: of edges and nodes, of windows per node.

Defined cases: null text has no words; documents of fewer than WINDOW words lose
nothing; rows with a null doc_id lose nothing and make no other row lose anything;
rows that share a doc_id don't make one another lose anything; an empty table gives
no rows; other columns are ignored by the report and untouched by dedup_rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, bounded, drop_files, free_name, materialize, mix64, text_bytes

WINDOW = 50
ANCHOR = 16
#: Longest period of a window that is a run's; no more than ANCHOR, so that the least k-mer of such a window comes again in it.
PERIOD = 16
_BASE = 0x9E3779B97F4A7C15 | 1
#: back and stop: where the edge in begins and the edge out ends; first and last: the windows that the anchor stands for;
#: final: whether the edge out ends with the document; out: hash of the edge out; around: of both edges; head: of a first anchor's edge in.
#: Rows with nth -1 are periodic windows: node is the window's hash, and windows that equal it cover the words from pos to stop.
OCCURRENCES = "doc_id long, rid long, nth int, pos int, back int, stop int, first int, last int, final int, node long, out long, around long, head long"


class Runs:
    """Hashes of any run of words, from prefix sums of a polynomial modulo 2^64."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, w: np.ndarray):
        if len(Runs._up) <= len(w):
            n = 2 * len(w) + 1
            inverse = np.uint64(pow(_BASE, -1, 1 << 64))
            Runs._up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(_BASE)))])
            Runs._down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse))])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * Runs._up[: len(w)])])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """mix64 of the hashes of words[start:stop]."""
        return mix64((self.sums[stop] - self.sums[start]) * Runs._down[start])


def periods(w: np.ndarray, h: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The least period of each window if it is PERIOD at most, else 0; h are the hashes of the k-mers, pos the places of the least ones."""
    out = np.zeros(len(w) - WINDOW + 1, np.int64)
    step = np.arange(1, PERIOD + 1)
    at = pos[:, None] + step
    again = (at < len(h)) & (h[np.minimum(at, len(h) - 1)] == h[pos][:, None])
    for p in step[again.any(axis=0)].tolist():
        same = np.concatenate([[0], np.cumsum(w[p:] == w[:-p])])
        whole = same[WINDOW - p :] - same[: len(same) - WINDOW + p] == WINDOW - p
        out[whole & (out == 0)] = p
    return out


def periodic(period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop): the distinct windows of each run of windows of one period, and where the last window that equals it ends."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], period, [0]])))
    start, stop = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if p := int(period[a]):
            at = np.arange(a, min(b, a + p))
            start.append(at)
            stop.append(at + (b - 1 - at) // p * p + WINDOW)
    return np.concatenate(start), np.concatenate(stop)


def anchors(runs: Runs, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text's anchors, their hashes, the first and last window that each stands for, and the windows' periods."""
    n = len(w)
    at = np.arange(n - ANCHOR + 1)
    h = runs.hash(at, at + ANCHOR)
    width = WINDOW - ANCHOR + 1
    view = sliding_window_view(h, width)
    pick = np.concatenate([view[a : a + 4096].argmin(axis=1) for a in range(0, len(view), 4096)]) + np.arange(len(view))
    first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    period = periods(w, h, pick[first])
    if period.any():
        other = np.flatnonzero(period == 0)
        new = np.flatnonzero(np.diff(pick[other], prepend=-1))
        first, last = other[new], other[np.append(new[1:], len(other)) - 1] if len(new) else other
    else:
        last = np.append(first[1:], len(view)) - 1
    pos = pick[first]
    return pos, h[pos], first, last, period


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, hashes of its words) for each text."""
    words = Words(text_bytes(batch.column("text")))
    ends = np.cumsum(words.count)
    for i, (a, b) in enumerate(zip((ends - words.count).tolist(), ends.tolist())):
        yield i, words.hash[a:b]


def occurrences(docs: DataFrame) -> DataFrame:
    """Every anchor of every text, with its place and the edges on its two sides, and the distinct windows of its periodic runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            parts = []
            doc_ids, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
            for i, w in _texts(batch):
                if len(w) < WINDOW:
                    continue
                runs = Runs(w)
                pos, node, first, last, period = anchors(runs, w)
                start, end = periodic(period) if period.any() else ((), ())
                if k := len(start):
                    none, zero = np.zeros(k, np.int64), np.zeros(k, np.uint64)
                    parts.append((np.full(k, doc_ids[i]), np.full(k, rids[i]), none - 1, start, none, end, none, none, none, runs.hash(start, start + WINDOW), zero, zero, zero))
                m = len(pos)
                if not m:
                    continue
                back = np.concatenate([[0], pos[:-1]])
                stop = np.concatenate([pos[1:] + ANCHOR, [len(w)]])
                edge = runs.hash(np.append(0, pos), np.append(pos[0] + ANCHOR, stop))
                edge[-1] = ~edge[-1]  # an edge to the document's end is another than the same words elsewhere
                edge[0] ^= np.uint64(_BASE)  # and so is one from its beginning
                head = np.zeros(m, np.uint64)
                head[0] = edge[0]
                parts.append((np.full(m, doc_ids[i]), np.full(m, rids[i]), np.arange(m), pos, back, stop, first, last, np.arange(m) == m - 1, node, edge[1:], mix64(edge[:-1] ^ mix64(edge[1:])), head))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                arrays = [pa.array(c, pa.int64()) for c in columns[:2]] + [pa.array(c.astype(np.int32)) for c in columns[2:9]] + [_signed(c) for c in columns[9:]]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in OCCURRENCES.split(", ")])

    return docs.filter("doc_id is not null and text is not null").mapInArrow(run, OCCURRENCES)


def compact(repeated: DataFrame) -> DataFrame:
    """The paths of plain nodes: (node, source, source_rid, at, before, after, tail, ends).

    node is the path's first node and at its place in the source; the path begins ``before`` words to the
    left of that place and ends ``after`` words to the right of it, and its last node begins ``tail`` words to the right; ends: it goes to the document's end.
    """
    source = repeated.filter("plain and doc_id = least")
    along = Window.partitionBy("doc_id", "rid").orderBy("nth")
    runs = source.withColumn("run", F.col("nth") - F.row_number().over(along)).groupBy("doc_id", "rid", "run")
    paths = runs.agg(F.min_by(F.struct("nth", "node", "pos", "back"), "nth").alias("a"), F.max_by(F.struct("pos", "stop", "final"), "nth").alias("z"))
    # a path that stands in its source more than once is one path; its first place counts
    first = F.min(F.struct(F.col("doc_id").alias("source"), F.col("rid").alias("source_rid"), F.col("a.pos").alias("at"), (F.col("a.pos") - F.col("a.back")).alias("before"), (F.col("z.stop") - F.col("a.pos")).alias("after"), (F.col("z.pos") - F.col("a.pos")).alias("tail"), F.col("z.final").alias("ends")))
    return paths.groupBy(F.col("a.node").alias("node")).agg(first.alias("p")).select("node", "p.*")


def path_pieces(repeated: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each occurrence of a path: its words [s, t), its source coordinates, and the windows that may stick out."""
    s = F.col("pos") - F.col("before")
    return repeated.filter("plain").join(paths, "node").select(
        "doc_id", "rid", "node", "least", s.alias("s"), (F.col("pos") + F.col("after")).alias("t"), "source", "source_rid", (F.col("at") - F.col("pos")).alias("shift"),
        F.array(
            # windows that begin left of the path, and those that end right of it
            F.struct("first", (s - 1).alias("last")),
            F.struct(F.greatest("first", F.col("pos") + F.col("after") - (WINDOW - 1)).alias("first"), F.when(F.col("ends") == 0, F.col("pos") + F.col("tail")).otherwise(-1).alias("last")),
        ).alias("ranges"),
    )


def edge_pieces(branching: DataFrame) -> DataFrame:
    """A row for each occurrence of a repeated edge at a branching node, or of one before a first branching node."""
    after = branching.select("doc_id", "rid", F.col("node").alias("u"), F.col("out").alias("edge"), F.col("pos").alias("s"), F.col("stop").alias("t"))
    before = branching.filter("nth = 0").select("doc_id", "rid", F.lit(0).cast("long").alias("u"), F.col("head").alias("edge"), F.lit(0).alias("s"), (F.col("pos") + ANCHOR).alias("t"))
    edges = after.unionByName(before)
    place = F.min(F.struct(F.col("doc_id").alias("d"), F.col("rid").alias("r"), F.col("s").alias("s")))
    found = edges.groupBy("u", "edge").agg(place.alias("p"), F.max("doc_id").alias("most")).filter("p.d < most")
    found = materialize(found.select("u", "edge", F.col("p.d").alias("source"), F.col("p.r").alias("source_rid"), F.col("p.s").alias("at")), "repeated-edges")
    placed = edges.join(found, ["u", "edge"])
    return placed.select("doc_id", "rid", "s", "t", "source", "source_rid", (F.col("at") - F.col("s")).alias("shift"))


def spans_of(pieces: DataFrame) -> DataFrame:
    """(doc_id, rid, s, t): pieces on one diagonal of a smaller document that overlap, joined."""
    along = Window.partitionBy("doc_id", "rid", "source", "source_rid", "shift").orderBy("s", "t")
    before = F.max("t").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begun = pieces.filter(F.col("source") < F.col("doc_id")).withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
    named = begun.withColumn("span", F.sum("new").over(along))
    return named.groupBy("doc_id", "rid", "source", "source_rid", "shift", "span").agg(F.min("s").alias("s"), F.max("t").alias("t")).filter(F.col("t") - F.col("s") >= WINDOW).select("doc_id", "rid", "s", "t")


def outside(ranges: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges of windows without the windows that lie inside a span."""
    out = []
    inner = sorted((s, t - WINDOW) for s, t in spans)
    for a, b in ranges:
        for s, e in inner:
            if s > b:
                break
            if e >= a:
                if s > a:
                    out.append((a, s - 1))
                a = e + 1
        if a <= b:
            out.append((a, b))
    return out


def unsettled(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, rid, node, least, first, last): the ranges of windows that no span of their document settles."""
    key = ["doc_id", "rid"]
    per = ranges.groupBy(*key).agg(F.collect_list(F.struct("node", "least", "first", "last")).alias("ranges"))
    per = per.join(spans.groupBy(*key).agg(F.collect_list(F.struct("s", "t")).alias("spans")), key, "left")
    schema = "doc_id long, rid long, node long, least long, first int, last int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, rid, r, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "ranges", "spans"))):
                inner = [(x["s"], x["t"]) for x in held or ()]
                rows += [(doc_id, rid, x["node"], x["least"], a, b) for x in r for a, b in outside([(x["first"], x["last"])], inner)]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in schema.split(", ")])

    return per.mapInArrow(run, schema)


def window_hashes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, node, doc_id, rid, at) of the wanted windows (doc_id, rid, ranges of node, first and last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out = []
            doc_ids, rids, wanted = (batch.column(c).to_pylist() for c in ("doc_id", "rid", "ranges"))
            for i, w in _texts(batch):
                ranges = [(r["node"], r["first"], min(r["last"], len(w) - WINDOW)) for r in wanted[i]]
                ranges = [r for r in ranges if r[1] <= r[2]]
                if not ranges:
                    continue
                n = np.array([b - a + 1 for _, a, b in ranges])
                at = np.concatenate([np.arange(a, b + 1) for _, a, b in ranges])
                node = np.repeat(np.array([x for x, _, _ in ranges], np.int64), n)
                out.append((Runs(w).hash(at, at + WINDOW).view(np.int64), node, np.full(len(at), doc_ids[i]), np.full(len(at), rids[i]), at.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["h", "node", "doc_id", "rid", "at"])

    # both sides grow with the corpus: never broadcast, so that small inputs run like large ones
    return docs.join(wanted.hint("merge"), ["doc_id", "rid"]).select("doc_id", "rid", "text", "ranges").mapInArrow(run, "h long, node long, doc_id long, rid long, at int")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, cuts): for every document that loses words, ranges [s, t) that cover all of them."""
    found = materialize(occurrences(docs), "anchors")
    in_runs = found.filter("nth < 0").select(F.col("node").alias("h"), "doc_id", "rid", F.col("pos").alias("s"), F.col("stop").alias("t"))
    again = in_runs.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    in_runs = in_runs.join(materialize(again, "repeated-runs"), "h").filter(F.col("doc_id") > F.col("least")).select("doc_id", "rid", "s", "t")
    in_runs = materialize(in_runs, "runs")
    occ = found.filter("nth >= 0")
    nodes = occ.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("around").alias("a"), F.max("around").alias("z"))
    # the key sides of these joins are written first: with an exchange on either side Spark can split a hot key's rows
    nodes = materialize(nodes.filter("least < most").select("node", "least", F.expr("a = z").alias("plain")), "repeated-nodes")
    repeated = materialize(occ.join(nodes, "node"), "repeated-anchors")
    drop_files(docs.sparkSession, found)
    paths = path_pieces(repeated, materialize(compact(repeated), "paths"))
    paths = materialize(paths, "path-pieces")
    branching = repeated.filter("not plain")
    place = ["doc_id", "rid", "s", "t", "source", "source_rid", "shift"]
    spans = materialize(spans_of(paths.select(*place).unionByName(edge_pieces(branching).select(*place))), "spans")
    ranges = branching.select("doc_id", "rid", "node", "least", "first", "last").unionByName(paths.select("doc_id", "rid", "node", "least", F.inline("ranges")).filter("first <= last"))
    left = materialize(unsettled(ranges, spans), "unsettled")
    asked = left.filter(F.col("least") < F.col("doc_id")).select("node").distinct()
    wanted = left.join(materialize(asked, "asked-nodes"), "node", "left_semi").groupBy("doc_id", "rid").agg(F.collect_set(F.struct("node", "first", "last")).alias("ranges"))
    hashes = materialize(window_hashes(docs.filter("text is not null"), wanted), "window-hashes")
    least = hashes.groupBy("h", "node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    single = hashes.join(materialize(least, "repeated-windows"), ["h", "node"]).filter(F.col("doc_id") > F.col("least")).select("doc_id", "rid", F.col("at").alias("s"), (F.col("at") + WINDOW).alias("t"))
    return spans.unionByName(single).unionByName(in_runs).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("s", "t")).alias("cuts"))


def gone_words(n: int, cuts: list[dict] | None) -> np.ndarray:
    """Which of n words the cuts cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for c in cuts or ():
        edge[c["s"]] += 1
        edge[c["t"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def kept_words(words: list[bytes], cuts: list[dict] | None) -> list[bytes]:
    return [w for w, g in zip(words, gone_words(len(words), cuts).tolist()) if not g] if cuts else words


def kept_text(text: bytes, cuts: list[dict]) -> bytes:
    """The text without the words that the cuts cover, each with the white space after it; all other bytes stay."""
    words = Words([text])
    gone = gone_words(len(words.start), cuts)
    until = np.append(words.start[1:], len(text))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for s, t in zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()):
        out.append(text[at : words.start[s]])
        at = int(until[t])
    return b"".join([*out, text[at:]])


def _row_id(docs: DataFrame) -> tuple[Column, bool]:
    """What tells rows of one doc_id apart: their text; nothing where every doc_id is unique (the second value)."""
    unique = docs.groupBy(F.col("doc_id").cast("long").alias("d")).count().filter("d is not null and count > 1").isEmpty()
    return F.lit(0).cast("long") if unique else F.xxhash64(F.col("text").cast("string")), unique


def _cuts(docs: DataFrame, rid: Column, unique: bool) -> DataFrame:
    """removals() of docs; wholly equal rows count once and share their cuts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), F.col("text").cast("string").alias("text"))
    return removals(rows if unique else rows.dropDuplicates(["doc_id", "rid"]))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            n, gone, sha = [], [], []
            for text, cuts in zip(text_bytes(batch.column("text")), batch.column("cuts").to_pylist()):
                words = text.split()
                kept = kept_words(words, cuts)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rid, unique = _row_id(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), F.col("text").cast("string").alias("text"))
    return source.join(_cuts(docs, rid, unique).hint("merge"), ["doc_id", "rid"], "left").drop("rid").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_rows(docs: DataFrame) -> DataFrame:
    """docs with the repeated words taken out of text and n_chars; a text that loses nothing stays as it is."""
    names = docs.columns
    row, doc, rid_, cuts_ = (free_name(docs, n) for n in ("row", "doc", "rid", "cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            cuts = batch.column(cuts_).to_pylist()
            texts = [kept_text(t.encode(), c).decode() if c and t is not None else t for t, c in zip(batch.column("text").to_pylist(), cuts)]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([n if c is None or t is None else len(t) for n, c, t in zip(batch.column("n_chars").to_pylist(), cuts, texts)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    rid, unique = _row_id(docs)
    cuts = _cuts(docs, rid, unique).select(F.col("doc_id").alias(doc), F.col("rid").alias(rid_), F.col("cuts").alias(cuts_))
    joined = docs.withColumn(row, rid).join(cuts.hint("merge"), (F.col("doc_id") == F.col(doc)) & (F.col(row) == F.col(rid_)), "left")
    return joined.select(*names, cuts_).mapInArrow(run, docs.schema)
