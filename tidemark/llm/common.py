"""Shared pieces: byte-level words, bounded batches, hash mixing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.scratch import drop_files, materialize, scratch  # noqa: F401  the operators here take them from this module
from tidemark.plans.session import ship

#: A word is a run of bytes outside these; ``bytes.split()`` cuts at exactly this set.
WHITE = " \t\n\x0b\x0c\r"
#: Text bytes that a Python worker handles at one time.
BATCH_BYTES = 8 << 20


def _give_back_memory() -> None:
    """Freed arrays of a megabyte and more go back to the system, so that a worker which waits stays small."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD of the GNU C library; others have no mallopt
    except (OSError, AttributeError):
        return


_give_back_memory()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_crc(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text; a null doc_id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bounded(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about ``limit`` bytes of text; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        cut = (np.cumsum(sizes) // limit)
        edges = np.flatnonzero(np.diff(cut)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, for uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Masks of the first n bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Eight-byte steps that a word is hashed in; longer words take the library's XXH64.
_STEPS = 512


class Words:
    """The words of texts, found and hashed as whole arrays.

    ``hash`` holds a 64-bit hash of each word, ``count`` the number of words of each
    text; ``start`` and ``stop`` are places in ``data``, the texts joined by a space,
    where text i begins at ``text_at[i]``. With lower, A-Z count as a-z.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        space = _SPACE[self.data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.stop = edges[0::2], edges[1::2]
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.text_at = np.cumsum(sizes) - sizes
        self.count = np.diff(np.append(np.searchsorted(self.start, self.text_at), len(self.start)))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        eights = np.ndarray((len(self.data) - 7,), "<u8", buffer=self.data, strides=(1,))
        size = self.stop - self.start
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = mix64(h ^ (eights[self.start] & _FIRST[np.minimum(size, 8)]))
        live = np.flatnonzero(size > 8)
        for j in range(8, 8 * _STEPS, 8):
            if not len(live):
                return h
            h[live] = mix64(h[live] ^ (eights[self.start[live] + j] & _FIRST[np.minimum(size[live] - j, 8)]))
            live = live[size[live] > j + 8]
        for i in live.tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.stop[i]].tobytes())
        return h


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have in any case."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name
