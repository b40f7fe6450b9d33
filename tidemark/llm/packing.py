"""Sum-of-squares packing of tokenized documents into sequences.

A document is cut into pieces only where it is longer than a sequence. Each
piece is placed where the sum over gaps of (open sequences with that gap)^2
becomes smallest. Pieces are dealt into groups of bounded token count; every
group is packed by itself, largest pieces first. Sequences that a group leaves
short of full are dissolved, and what all groups left over is packed again in
groups of the same bound, until one group is left or a round dissolves nothing
that could still be joined.

Defined cases: null text is the empty text and gives the end id alone; repeated
rows are packed each for itself; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize
from .tokens import tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, _row long, _group long, _bin long, offset long, _fill long"
#: Pieces of one group, about: what one task packs at a time.
GROUP_PIECES = 1 << 16
#: A sequence with more than this share of free places is packed again with others.
LOOSE = 0.02


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece, with the CRC of its ids; the ids themselves are not kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in bounded(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = tok.encode_bytes(text or "") + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each length, taken in the given order.

    count[g] holds how many open sequences have g free places. Putting a length
    into gap g changes the sum of squares by 2 * (count[g - length] - count[g]) + 2,
    one less where the sequence becomes full or is new, as one class less changes.
    The tightest gap wins ties.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    usable = np.zeros(capacity + 1, dtype=np.int64)  # 0 where a gap class is open, else a bar
    usable[:] = 1 << 40
    usable[capacity] = 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    n_bins = 0
    for i, a in enumerate(lengths.tolist()):
        # of gap g >= a: what the class that loses and the class that gains contribute
        change = 2 * (count[: capacity + 1 - a] - count[a:]) + usable[a:]
        change[0] -= 1  # a full sequence leaves the classes
        if a < capacity:
            change[-1] = 2 * count[capacity - a] - 1  # a new sequence leaves no class
        gap = int(change.argmin()) + a
        if gap == capacity and not open_bins[capacity]:
            b = n_bins
            n_bins += 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
            if not count[gap] and gap < capacity:
                usable[gap] = 1 << 40
        bins[i], offsets[i] = b, capacity - gap
        left = gap - a
        if left:
            open_bins[left].append(b)
            count[left] += 1
            usable[left] = 0
    return bins, offsets


def pack(rows: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces()."""
    spark = rows.sparkSession
    left = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "_row"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=pdf["length"]).astype(np.int64)
        return pdf.assign(_bin=bins, offset=offsets, _fill=fill[bins])

    done, level, n = None, 0, left.count()
    groups = 0
    while n:
        before, groups = groups, max(1, -(-n // group_pieces))
        dealt = left.select(*[c.split()[0] for c in PIECES.split(", ")], "_row", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)).alias("_group"))
        placed = materialize(dealt.groupBy("_group").applyInPandas(place, PLACED), f"packed-{level}")
        # sequence numbers of one level and group never meet those of another
        out = placed.withColumn("sequence_id", (F.lit(level) * (1 << 56)) + F.col("_group") * (1 << 24) + F.col("_bin"))
        loose = F.col("_fill") < int(capacity * (1 - LOOSE))
        last = groups == 1 or level == 60 or groups == before
        part = out if last else out.filter(~loose)
        done = part if done is None else done.unionByName(part)
        if last:
            break
        left = placed.filter(loose)
        n, level = left.count(), level + 1
    if done is None:
        return left.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).drop("_row")
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
