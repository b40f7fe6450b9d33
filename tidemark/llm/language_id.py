"""Language identification with bit-sliced Bloom filters of byte n-grams.

One Bloom table serves all languages: each cell holds a mask with one bit a
language, and the AND over an n-gram's cells is the set of all languages whose
training texts contain it. Per language the hits are counted over a text, corrected
for that language's false-positive rate, and the largest share decides.

The table is filled by a distributed OR: no n-gram list is gathered. It grows with the
corpus: while the n-grams of some language set more than MOST_FILL of its bits, the table
is made four times as large and filled again, up to MOST_BITS, beyond which it is an
error. So the false positives that the correction takes out stay few. All training rows count.

Defined cases: null text, or a text without a letter, gives ``und`` and score 0;
a text whose n-grams are all unknown gets the language of most training rows and score 0;
without training rows all is ``und``; rows with a null language train nothing;
ties go to the language that sorts first; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, mix64

GRAM = 4
HASHES = 3
#: The Bloom table has 2 to this many cells at first, and at most: 16 and 256 MB for 64 languages.
CELL_BITS, MOST_BITS = 21, 25
#: The share of a language's bits from which on the table is too small.
MOST_FILL = 0.2
#: ASCII bytes that are no letters become spaces; bytes of other scripts stay.
_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram codes of the texts inside words, and each text's first position among them."""
    parts = [b" ".join([b"", *t.lower().encode().translate(_TO_SPACE).split(), b""]) for t in texts]
    joined = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(n)
    if len(joined) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    code = np.zeros(len(joined) - GRAM + 1, dtype=np.uint32)
    for j in range(GRAM):
        code |= joined[j : len(joined) - GRAM + 1 + j].astype(np.uint32) << np.uint32(8 * j)
    space = joined == 0x20
    # a space may stand at either end, never inside
    keep = ~(space[1 : len(code) + 1] | space[2 : len(code) + 2])
    doc = np.repeat(np.arange(len(texts)), n)[: len(code)]
    last = np.repeat(ends, n)[: len(code)]
    keep &= np.arange(len(code)) + GRAM <= last
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(texts)))])
    return code[keep], starts


def cells_of(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The cells of each n-gram, hash by hash."""
    h = mix64(codes.astype(np.uint64) + np.uint64(0x51ED27))
    step = (h >> np.uint64(40)) | np.uint64(1)
    for _ in range(HASHES):
        yield (h & np.uint64((1 << bits) - 1)).astype(np.int64)
        h = h + step


class Model:
    """Languages, the index of the usual one, the table of masks (planes of 64 languages, cells), and each language's false-positive rate."""

    def __init__(self, langs: list[str], usual: int, table: np.ndarray):
        self.langs, self.usual, self.table = langs, usual, table
        self.bits = table.shape[1].bit_length() - 1
        self.fill = np.array([float(((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))])
        self.false = self.fill**HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes, starts = grams([t or "" for t in texts])
        n = np.diff(starts)
        share = np.zeros((len(texts), len(self.langs)))
        cells = list(cells_of(codes, self.bits))
        for p in range(len(self.table)):
            mask = np.bitwise_and.reduce([self.table[p][c] for c in cells]) if len(codes) else np.empty(0, np.uint64)
            for i in range(64 * p, min(64 * (p + 1), len(self.langs))):
                running = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                hits = running[starts[1:]] - running[starts[:-1]]
                share[:, i] = np.maximum(0, (hits / np.maximum(n, 1) - self.false[i]) / max(1e-9, 1 - self.false[i]))
        sums = share.sum(axis=1) if self.langs else np.zeros(len(texts))
        langs, scores = [], []
        for k, t in enumerate(texts):
            if not self.langs or not t or not any(map(str.isalpha, t)):
                langs.append("und")
                scores.append(0.0)
            elif sums[k] <= 0:
                langs.append(self.langs[self.usual])
                scores.append(0.0)
            else:
                best = int(share[k].argmax())
                langs.append(self.langs[best])
                scores.append(float(share[k, best] / sums[k]))
        return langs, scores


def fit(train: DataFrame, cell_bits: int = CELL_BITS) -> Model:
    """The model of all rows of train (text, lang), with a table that is large enough for them."""
    while True:
        model = filled(train, cell_bits)
        if not (model.fill > MOST_FILL).any():
            return model
        if cell_bits >= MOST_BITS:
            raise ValueError(f"a language fills {model.fill.max():.2f} of a table of 2^{cell_bits} cells")
        cell_bits = min(MOST_BITS, cell_bits + 2)


def filled(train: DataFrame, cell_bits: int) -> Model:
    """Fills a table of 2^cell_bits cells with the n-grams of all rows of train."""
    rows = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    # one row a language; both collects are bounded by the languages and the cells
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    index = {x: i for i, x in enumerate(langs)}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in bounded(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                held = seen.setdefault(lang, np.zeros(1 << cell_bits, dtype=bool))
                for cell in cells_of(grams(texts)[0], cell_bits):
                    held[cell] = True
        planes: dict[int, np.ndarray] = {}
        for lang, held in seen.items():
            plane = planes.setdefault(index[lang] // 64, np.zeros(1 << cell_bits, dtype=np.uint64))
            plane[held] |= np.uint64(1) << np.uint64(index[lang] % 64)
        for p, plane in planes.items():
            cell = np.flatnonzero(plane)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), p, np.int32)), pa.array(cell.astype(np.int32)), pa.array(plane[cell].view(np.int64))], ["plane", "cell", "mask"])

    masks = rows.mapInArrow(fill, "plane int, cell int, mask long").groupBy("plane", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros((max(1, -(-len(langs) // 64)), 1 << cell_bits), dtype=np.uint64)
    table[masks.column("plane").to_numpy(), masks.column("cell").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return Model(langs, max(range(len(langs)), key=lambda i: sizes[langs[i]], default=-1), table)


def identify(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            langs, scores = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return source.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
