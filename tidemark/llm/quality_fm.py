"""A factorisation machine that scores text quality.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
the pairwise interactions of all features in time linear in their number. Features
are hashed lower-cased words, binned structure statistics of the text and one
metadata value, the length in characters; labels, lang, source and doc_id are no
features. It is trained with AdaGrad on a bounded sample of labelled rows, chosen
by hash of the id, and calibrated on a part held out of that sample.

Defined cases: null text is the empty text and gets a score from the structure
statistics alone; without labelled rows, or with one class only, every score is
the share of label 1 among them (0.5 without any); repeated labels of one id count
as their maximum; null labels train nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: Labelled rows used for training, at most: a documented bound of the fit, not of the scoring.
TRAIN_ROWS = 8_000
#: Hash buckets of words; structure bins follow after them.
WORD_BITS = 15
BINS = 12
RANK = 8
_DIGIT = bytes(range(0x30, 0x3A))
_SYMBOLS = b"#*$%&|<>!"
_STOPS = b".,;:?"


@dataclass
class Features:
    """CSR rows: values of row r are at indptr[r]:indptr[r + 1]."""

    indptr: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _structure(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Statistics between 0 and 1, each to be binned."""
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    low = raw.lower()
    return [
        min(1.0, math.log1p(len(words)) / 12),
        min(1.0, (size - raw.count(b" ")) / n / 20),
        len(counts) / n,
        counts.most_common(1)[0][1] / n if counts else 0.0,
        min(1.0, 4 * (size - len(raw.translate(None, _SYMBOLS))) / size),
        min(1.0, 4 * (size - len(raw.translate(None, _DIGIT))) / size),
        min(1.0, 4 * (size - len(raw.translate(None, _STOPS))) / size),
        1 - _same(raw, low) / size if raw else 0.0,
        1 - len(set(lines)) / n_lines,
        min(1.0, math.log1p(size / n_lines) / 10),
        min(1.0, math.log1p(size) / 14),  # metadata: the length in bytes
    ]


def _same(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum())


N_STRUCTURE = 11
SIZE = (1 << WORD_BITS) + N_STRUCTURE * BINS


def featurize(texts: list[str | None], known: dict[bytes, int]) -> Features:
    """Features of the texts; known caches word buckets and is cleared when large."""
    if len(known) > 500_000:
        known.clear()
    indptr, index, value = [0], [], []
    for t in texts:
        raw = (t or "").encode()
        words = raw.lower().split()
        counts = Counter(words)
        for w in [w for w in counts if w not in known]:
            known[w] = xxhash.xxh32_intdigest(w) & ((1 << WORD_BITS) - 1)
        ids = np.array([known[w] for w in counts], dtype=np.int32)
        x = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        norm = float(np.sqrt((x * x).sum())) or 1.0
        stats = _structure(raw, words, counts)
        bins = [(1 << WORD_BITS) + k * BINS + min(BINS - 1, int(s * BINS)) for k, s in enumerate(stats)]
        index += [ids, np.array(bins, dtype=np.int32)]
        value += [x / norm, np.full(len(bins), 0.5, np.float32)]
        indptr.append(indptr[-1] + len(ids) + len(bins))
    return Features(np.array(indptr, dtype=np.int64), np.concatenate(index or [np.empty(0, np.int32)]), np.concatenate(value or [np.empty(0, np.float32)]))


@dataclass
class Machine:
    """w0, w and v of the machine, and the calibration of its margin."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, f: Features) -> np.ndarray:
        if len(f.indptr) < 2:
            return np.empty(0)
        at = f.indptr[:-1]
        xv = self.v[f.index] * f.value[:, None]
        s = np.add.reduceat(xv, at, axis=0)
        q = np.add.reduceat(xv * xv, at, axis=0)
        return self.w0 + np.add.reduceat(self.w[f.index] * f.value, at) + 0.5 * (s * s - q).sum(axis=1)

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(f) + self.shift, -35, 35)))


def _take(f: Features, rows: np.ndarray) -> Features:
    n = np.diff(f.indptr)[rows]
    ends = np.cumsum(n)
    at = np.repeat(f.indptr[rows] - (ends - n), n) + np.arange(int(n.sum()))
    return Features(np.concatenate([[0], ends]), f.index[at], f.value[at])


def train(f: Features, y: np.ndarray, epochs: int = 6, rate: float = 0.08, l2: float = 1e-5, seed: int = 3) -> Machine:
    """AdaGrad over mini-batches, classes weighted equally, then Platt scaling on a fifth of the rows."""
    n = len(y)
    share = float(y.mean()) if n else 0.5
    m = Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))
    if not 0 < share < 1 or n < 20:
        p = min(max(share, 1e-6), 1 - 1e-6)
        m.w0 = math.log(p / (1 - p))
        return m
    rng = np.random.default_rng(seed)
    m.v = rng.normal(0, 0.03, (SIZE, RANK)).astype(np.float32)
    gw, gv, g0 = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, RANK), 1e-2, np.float32), 1e-2
    order = rng.permutation(n)
    test, fit = order[: n // 5], order[n // 5 :]
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        rng.shuffle(fit)
        for a in range(0, len(fit), 128):
            rows = fit[a : a + 128]
            b = _take(f, rows)
            g = ((1 / (1 + np.exp(-np.clip(m.margin(b), -35, 35))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            doc = np.repeat(np.arange(len(rows)), np.diff(b.indptr))
            xv = m.v[b.index] * b.value[:, None]
            s = np.add.reduceat(xv, b.indptr[:-1], axis=0)
            gx = (g[doc] * b.value)[:, None]
            uniq, slot = np.unique(b.index, return_inverse=True)
            dw = np.bincount(slot, weights=gx[:, 0]) + l2 * m.w[uniq]
            dv = np.stack([np.bincount(slot, weights=gx[:, 0] * (s[doc, k] - xv[:, k])) for k in range(RANK)], axis=1) + l2 * m.v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            g0 += float(g.sum()) ** 2
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= rate * dv / np.sqrt(gv[uniq])
            m.w0 -= rate * float(g.sum()) / math.sqrt(g0)
    z, t = m.margin(_take(f, test)), y[test]
    for _ in range(200):  # gradient steps on the two calibration parameters
        p = 1 / (1 + np.exp(-np.clip(m.scale * z + m.shift, -35, 35)))
        m.scale = float(np.clip(m.scale - 0.5 * ((p - t) * z).mean(), 0.2, 10))
        m.shift -= 0.5 * float((p - t).mean())
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, eligible: Column, target: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled ids, those with the least hashes."""
    ids = labels.filter(eligible & F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def fit(sample: DataFrame) -> Machine:
    """Trains on rows (doc_id, text, y); featurized on the executors, trained on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in bounded(batches):
            f = featurize(batch.column("text").to_pylist(), known)
            index = pa.ListArray.from_arrays(pa.array(f.indptr.astype(np.int32)), pa.array(f.index))
            value = pa.ListArray.from_arrays(pa.array(f.indptr.astype(np.int32)), pa.array(f.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), index, value], ["doc_id", "y", "index", "value"])

    got = sample.mapInArrow(run, "doc_id long, y int, index array<int>, value array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    index, value = got.column("index").combine_chunks(), got.column("value").combine_chunks()
    n = np.array([len(x) for x in index], dtype=np.int64) if len(got) else np.empty(0, np.int64)
    f = Features(np.concatenate([[0], np.cumsum(n)]), index.flatten().to_numpy(), value.flatten().to_numpy()) if len(got) else featurize([], {})
    return train(f, got.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, machine: Machine, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in bounded(batches):
            p = sent.value.score(featurize(batch.column("text").to_pylist(), known))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p.astype(np.float64))], ["doc_id", "held_out", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double")


def filter_rows(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in bounded(batches):
            p = sent.value.score(featurize(batch.column("text").to_pylist(), known))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
