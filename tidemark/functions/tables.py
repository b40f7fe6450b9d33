"""Table functions: Arrow batches in, Arrow batches out, with a table argument."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import chunk


@F.arrow_udtf(returnType="id bigint, chunk int, start int, body string")
class Chunks:
    """Pieces of the texts of a table (id, body, size, overlap); sizes are constant columns."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = []
        for r in batch.to_pylist():
            at = 0
            for k, piece in enumerate(chunk(r["body"] or "", r["size"], r["overlap"])):
                at = max(0, (r["body"] or "").find(piece, max(0, at - r["overlap"])))
                rows.append({"id": r["id"], "chunk": k, "start": at, "body": piece})
                at += len(piece)
        yield pa.Table.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("chunk", pa.int32()), ("start", pa.int32()), ("body", pa.string())]))


@F.arrow_udtf(returnType="id bigint, word_from int, word_to int, n_words int")
class NgramSpans:
    """Word windows of 1 to 3 words of the texts of a table (id, body)."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = []
        for r in batch.to_pylist():
            n = len((r["body"] or "").split())
            rows += [{"id": r["id"], "word_from": i, "word_to": i + k - 1, "n_words": k} for k in (1, 2, 3) for i in range(n - k + 1)]
        yield pa.Table.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("word_from", pa.int32()), ("word_to", pa.int32()), ("n_words", pa.int32())]))


def chunked(df: DataFrame, id_: str, text: str, size: int, overlap: int) -> DataFrame:
    """(id, chunk, start, body) of every text, by a table function over the whole table."""
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("body"), F.lit(size).alias("size"), F.lit(overlap).alias("overlap"))
    return Chunks(rows.asTable())
