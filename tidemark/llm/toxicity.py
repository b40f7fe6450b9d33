"""A linear-chain conditional random field that tags toxic spans and scores documents.

Tokens are runs of ASCII letters, digits and bytes above 127, A-Z lower-cased, each
labelled clean or toxic. A token's features are its hash and the hashes of its first
3 to 8 bytes, so words that share a stem share weight. Labels are given for whole
documents only; labelled tokens come from them: a token of a toxic document is
taken as toxic if one of its features is found in toxic documents far beyond chance
(a G statistic), all tokens of clean documents are clean. The field is trained on the
sentences that hold such features and on others, then tags the toxic documents
itself, by its marginals, and is trained again on what it has tagged.

A document's score comes from the forward-backward marginals of its whole text: a
logistic function of the expected number of toxic tokens, the largest marginal and
the length, fitted on documents that the field was not trained on, with the classes
weighted as they occur. Runs of tokens with a marginal of a half and more are the
offending spans, by offsets in code points.

The fit uses a bounded sample: at most SAMPLE_ROWS labelled texts of each class, by
hash of the id, equal texts once, none over SAMPLE_BYTES bytes. Scoring has no bound:
the chain runs over all tokens of every text.

Defined cases: a null text and a text without tokens have the score of no toxic
token and no spans; without labelled rows, or with one class only, every score is
the share of label 1 (0.5 without any); labels of one id count as their maximum, null
labels train nothing; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _FIRST, Words, bounded, mix64, text_bytes

#: Documented bounds of the fit: labelled texts of each class, and the bytes of one.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 100_000
#: Hash buckets of features, and the prefixes, in bytes, that are features.
BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature marks tokens as toxic from this G statistic on (p below 1e-6), in twice as large a share of the toxic documents.
MARK_G, MARK_RATIO = 24.0, 3.0
#: Clean sentences trained on for each sentence with a marked token, and sentences at most.
CLEAN_PER_MARKED, SENTENCES = 4, 24_000
MAX_SENTENCE = 400
EPOCHS, RATE, L2 = 12, 0.2, 1e-4
#: Marginals below this add nothing to the expected number, so that long clean texts don't add up.
LEAST = 0.05

_KEEP = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_ENDS = b".!?\n"


def _tokens(texts: list[bytes]) -> Words:
    return Words([t.translate(_KEEP) for t in texts], lower=True)


def features(w: Words) -> np.ndarray:
    """(tokens, 1 + prefixes) buckets; a prefix as long as its token has the token's own bucket."""
    eights = np.ndarray((len(w.data) - 7,), "<u8", buffer=w.data, strides=(1,))
    head = eights[w.start] if len(w.start) else np.empty(0, np.uint64)
    size = w.stop - w.start
    out = np.empty((len(size), 1 + len(PREFIXES)), dtype=np.int32)
    shift = np.uint64(64 - BITS)
    out[:, 0] = (mix64(w.hash) >> shift).astype(np.int32)
    for k, n in enumerate(PREFIXES, 1):
        salt = np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
        key = (mix64((head & _FIRST[n]) + salt) >> shift).astype(np.int32)
        out[:, k] = np.where(size > n, key, out[:, 0])
    return out


@dataclass
class Chain:
    """The field: weights of features for the toxic label, transition[a, b] from label a to b, and the document's logistic function."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = 0.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logit: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None

    def emissions(self, f: np.ndarray) -> np.ndarray:
        """The score of the toxic label over the clean one, at each token."""
        out = np.full(len(f), self.bias, dtype=np.float64)
        for k in range(f.shape[1]):
            out += self.weight[f[:, k]]
        return out

    def marginals(self, emission: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each token, and the summed pair marginals (2, 2); all sequences advance together."""
        return forward_backward(emission, lens, self.transition)

    def score(self, p: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The documents' scores from their tokens' marginals."""
        if self.constant is not None:
            return np.full(len(lens), self.constant)
        return 1 / (1 + np.exp(-np.clip(summary(p, lens) @ self.logit, -35, 35)))


def forward_backward(emission: np.ndarray, lens: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic label and summed pair marginals of the sequences that ``lens`` cuts emission into.

    Two labels need one number a step, the odds of the forward and of the backward
    messages. Sequences are sorted by length, so step t runs over the first ones.
    """
    n = len(emission)
    pairs = np.zeros((2, 2))
    if not n:
        return np.empty(0), pairs
    start = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    start, lens = start[order], lens[order]
    live = np.searchsorted(-lens, -np.arange(1, int(lens[0]) + 1), side="right")  # sequences that have a token t
    w = np.exp(transition)
    e = np.exp(np.clip(emission, -60, 60))
    fwd, back = np.empty(n), np.empty(n)
    at = start[: live[0]]
    fwd[at] = r = e[at]
    for t in range(1, len(live)):
        m = live[t]
        r = r[:m]
        at = start[:m] + t
        r = np.clip(e[at] * (w[0, 1] + r * w[1, 1]) / (w[0, 0] + r * w[1, 0]), 1e-30, 1e30)
        fwd[at] = r
    back[start[: live[0]] + lens[: live[0]] - 1] = 1.0
    r = np.empty(0)
    for t in range(len(live) - 1, 0, -1):
        m = live[t]
        x = np.concatenate([r, np.ones(m - len(r))]) * e[start[:m] + t]
        r = (w[1, 0] + x * w[1, 1]) / (w[0, 0] + x * w[0, 1])
        back[start[:m] + t - 1] = r
    odds = fwd * back
    p = odds / (1 + odds)
    inner = np.ones(n, dtype=bool)
    inner[start[: live[0]] + lens[: live[0]] - 1] = False
    i = np.flatnonzero(inner)
    if len(i):
        a, x = fwd[i], back[i + 1] * e[i + 1]
        cells = np.stack([np.full(len(i), w[0, 0]), x * w[0, 1], a * w[1, 0], a * x * w[1, 1]])
        pairs = (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return p, pairs


def summary(p: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """(documents, 4): one, log of the expected toxic tokens, logit of the largest marginal, log of the length."""
    doc = np.repeat(np.arange(len(lens)), lens)
    expected = np.bincount(doc, weights=np.where(p >= LEAST, p, 0.0), minlength=len(lens))
    top = np.zeros(len(lens))
    some = np.flatnonzero(lens)
    if len(some):
        top[some] = np.maximum.reduceat(p, (np.cumsum(lens) - lens)[some])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(lens)), np.log(0.02 + expected), np.log(top / (1 - top)), np.log1p(lens)], axis=1)


def _marked(buckets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose documents are toxic far beyond chance."""
    n = np.array([max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))], dtype=np.float64)
    seen = np.zeros((2, 1 << BITS))
    for b, label in zip(buckets, y.tolist()):
        seen[int(label), np.unique(b)] += 1
    out = np.zeros(1 << BITS, dtype=bool)
    a, c = seen[1], seen[0]
    at = np.flatnonzero((a + 0.5) / (n[1] + 1) > MARK_RATIO * (c + 0.5) / (n[0] + 1))
    share = (a[at] + c[at]) / n.sum()
    share = np.clip(share, 1e-9, 1 - 1e-9)
    xlog = lambda k, m, q: k * np.log(np.maximum(k, 1e-12) / (m * q)) + (m - k) * np.log(np.maximum(m - k, 1e-12) / (m * (1 - q)))
    out[at[2 * (xlog(a[at], n[1], share) + xlog(c[at], n[0], share)) >= MARK_G]] = True
    return out


def _sentences(texts: list[bytes], w: Words) -> np.ndarray:
    """The sentence of each token, counted through all texts; long ones are cut."""
    ends = np.zeros(len(w.data) + 1, dtype=np.int64)
    joined = np.frombuffer(b"\n".join(texts) + b"\n" * 9, dtype=np.uint8)
    ends[1:] = np.cumsum(np.isin(joined, np.frombuffer(_ENDS, np.uint8)))
    at = ends[w.start]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return np.cumsum(np.concatenate([[0], (place[1:] % MAX_SENTENCE == 0).astype(np.int64)])) if len(at) else at


def train_chain(f: np.ndarray, y: np.ndarray, lens: np.ndarray, weight: np.ndarray, start: Chain | None = None, seed: int = 5) -> Chain:
    """Maximises the sequences' conditional likelihood by AdaGrad; weight is each sequence's."""
    c = start or Chain()
    gw, gb, gt = np.full(1 << BITS, 1e-2, np.float32), 1e-2, np.full((2, 2), 1e-2)
    at, rng = np.cumsum(lens) - lens, np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(lens)), max(1, len(lens) // 256)):
            n = lens[rows]
            i = np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            p, pairs = c.marginals(c.emissions(f[i]), n)
            g = (p - y[i]) * np.repeat(weight[rows], n) / len(rows)
            inner = np.ones(len(i), dtype=bool)
            inner[np.cumsum(n) - 1] = False
            k = np.flatnonzero(inner)
            held = np.bincount((2 * y[i][k] + y[i][np.minimum(k + 1, len(i) - 1)]).astype(np.int64), minlength=4).reshape(2, 2)
            flat, gx = f[i].ravel(), np.repeat(g, f.shape[1])
            uniq, slot = np.unique(flat, return_inverse=True)
            dw = np.bincount(slot, weights=gx) + L2 * c.weight[uniq]
            gw[uniq] += (dw * dw).astype(np.float32)
            c.weight[uniq] -= (RATE * dw / np.sqrt(gw[uniq])).astype(np.float32)
            db, dt = float(g.sum()), (pairs - held) / len(rows) + L2 * c.transition
            gb, gt = gb + db * db, gt + dt * dt
            c.bias -= RATE * db / math.sqrt(gb)
            c.transition = c.transition - RATE * dt / np.sqrt(gt)
            c.transition[0, 0] = 0.0  # one of the four is free
    return c


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        b -= np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.1 * b)
    return b


def train(texts: list[bytes], y: np.ndarray, classes: tuple[int, int]) -> Chain:
    """The field from whole texts and their labels; classes are the numbers of clean and toxic documents in all."""
    n = sum(classes)
    if min(classes) == 0 or len(texts) < 20 or not 0 < y.mean() < 1:
        return Chain(constant=classes[1] / n if n else 0.5)
    test = np.arange(len(texts)) % 3 == 0
    fit_at = np.flatnonzero(~test)
    parts = [texts[i] for i in fit_at]
    w = _tokens(parts)
    f = features(w)
    doc = np.repeat(np.arange(len(parts)), w.count)
    label = y[fit_at]
    cuts = np.cumsum(w.count)[:-1]
    marked = _marked(np.split(f, cuts), label)
    toxic = label[doc] == 1
    tag = toxic & marked[f].any(axis=1)
    candidate = marked[f].any(axis=1)
    sentence = _sentences(parts, w)
    n_sentences = int(sentence[-1]) + 1 if len(sentence) else 0
    held = np.bincount(sentence, weights=candidate, minlength=n_sentences) > 0
    rng = np.random.default_rng(11)
    with_mark, without = np.flatnonzero(held), np.flatnonzero(~held)
    with_mark = rng.permutation(with_mark)[: SENTENCES // 2]
    plain = rng.permutation(without)[: min(SENTENCES // 2, max(2000, CLEAN_PER_MARKED * len(with_mark)))]
    weight = np.ones(n_sentences)
    chosen = np.zeros(n_sentences, dtype=bool)
    chosen[with_mark], chosen[plain] = True, True
    keep = np.flatnonzero(chosen[sentence])
    chain = None
    for _ in range(2):
        lens = np.bincount(sentence[keep], minlength=n_sentences)[chosen]
        lens = lens[lens > 0]
        seen = np.unique(sentence[keep])
        chain = train_chain(f[keep], tag[keep].astype(np.float64), lens, weight[seen])
        p, _pairs = chain.marginals(chain.emissions(f), w.count)
        tag = toxic & (p >= 0.5)  # the field tags the toxic documents itself
    held_texts = [texts[i] for i in np.flatnonzero(test)]
    v = _tokens(held_texts)
    p, _pairs = chain.marginals(chain.emissions(features(v)), v.count)
    yt = y[test]
    weight = np.where(yt > 0, classes[1] / n / max(yt.mean(), 1e-9), classes[0] / n / max(1 - yt.mean(), 1e-9))
    chain.logit = _logistic(summary(p, v.count), yt, weight)
    return chain


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, target: str = "toxic", rows: int = SAMPLE_ROWS) -> Chain:
    """Trains on the labelled documents whose id is eligible."""
    ids = labels.filter(eligible & F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(target) > 0).cast("int").alias("y"))
    # two rows: the sizes of the classes
    counts = dict(ids.groupBy("y").count().collect())
    classes = int(counts.get(0, 0)), int(counts.get(1, 0))
    if min(classes) == 0:
        return train([], np.empty(0), classes)
    # about twice the rows asked for by a threshold on the hash, so that no task sorts the whole class
    share = F.when(F.col("y") == 1, min(1.0, 2.5 * rows / classes[1])).otherwise(min(1.0, 2.5 * rows / classes[0]))
    near = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("_h", F.xxhash64("doc_id"))
    least = lambda v: near.filter(F.col("y") == v).orderBy("_h", "doc_id").limit(2 * rows)
    chosen = least(0).unionByName(least(1)).select("doc_id", "y")
    text = F.col("text").cast("string")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")
    distinct = sample.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("doc_id", "text", "y")).alias("r")).select("r.*")
    take = lambda v: distinct.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id")).limit(rows)
    got = take(0).unionByName(take(1)).toArrow().sort_by([("doc_id", "ascending")])
    order = np.random.default_rng(2).permutation(len(got))
    texts = text_bytes(got.column("text"))
    return train([texts[i] for i in order], got.column("y").to_numpy().astype(np.float64)[order], classes)


def _spans(raw: bytes, start: np.ndarray, stop: np.ndarray, p: np.ndarray) -> list[dict]:
    """Runs of toxic tokens as code-point offsets, with the largest marginal; start and stop are bytes."""
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return []
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": int(lead[start[r[0]]]), "stop": int(lead[stop[r[-1]]]), "marginal": float(p[r].max())} for r in runs]


def score(docs: DataFrame, chain: Chain, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score and the offending spans of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in bounded(batches):
            texts = text_bytes(batch.column("text"))
            w = _tokens(texts)
            p, _ = c.marginals(c.emissions(features(w)), w.count)
            cuts = np.concatenate([[0], np.cumsum(w.count)])
            found = []
            toxic = np.bincount(np.repeat(np.arange(len(texts)), w.count), weights=p >= 0.5, minlength=len(texts))
            for i, t in enumerate(texts):
                a, b = cuts[i], cuts[i + 1]
                found.append(_spans(t, w.start[a:b] - w.text_at[i], w.stop[a:b] - w.text_at[i], p[a:b]) if toxic[i] else [])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(c.score(p, w.count)), pa.array(found, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, spans array<struct<start:int,stop:int,marginal:double>>")
