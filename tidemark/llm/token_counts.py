"""Token counts per document from flat, unindexed token files.

A token file is a run of fixed-width little-endian ids; every document ends with
the end-of-document id and nothing says where. Files are cut into blocks. Each
block is searched for the id with one vector comparison and gives its separators'
places and one summary row; a prefix scan over the summaries (running count of
separators, running maximum of the last separator's place) stitches documents that
cross block boundaries, so no task reads more than its own block.

Defined cases: an empty file gives no documents; adjacent separators give a
document of no tokens; tokens after the last separator form an unfinished document
(``complete`` is false); a file whose size is no multiple of the id width raises.
In the query, null text is the empty text, repeated rows are counted each for
itself, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, scratch
from .tokens import tokenizer

#: Tokens of one block.
BLOCK_TOKENS = 4 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """Spark writes file URIs with one or three slashes; the rest goes to the store that the scheme names."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, width: int = 2) -> DataFrame:
    """Tokenizes docs into one flat file a partition; gives (file, nth, doc_id), the documents' order.

    A file is written under a temporary name and renamed, and its name depends on
    the partition only, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _open(folder)
        name = f"tokens-{task.partitionId():06d}.bin"
        store.create_dir(root, recursive=True)
        held = f"{root}/.{name}.{task.taskAttemptId()}"
        tok, nth = tokenizer(tokenizer_path), 0
        with store.open_output_stream(held) as out:
            for batch in bounded(batches):
                ids = batch.column("doc_id")
                flat = b"".join(tok.encode_bytes(t or "") + end_id.to_bytes(4, "little") for t in batch.column("text").to_pylist())
                tokens = np.frombuffer(flat, dtype="<u4")
                if len(tokens) and int(tokens.max()) >= 1 << (8 * width):
                    raise ValueError(f"token {tokens.max()} does not fit into {width} bytes")
                if int((tokens == end_id).sum()) != len(ids):
                    raise ValueError(f"a text holds the end token {end_id}")
                out.write(tokens.astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(np.arange(nth, nth + len(ids))), ids], ["file", "nth", "doc_id"])
                nth += len(ids)
        store.move(held, f"{root}/{name}")

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(source.mapInArrow(run, "file string, nth long, doc_id long"), "token-order")


def blocks(spark: SparkSession, folder: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, path, block, start, length) of every block, from the files' sizes alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    sized = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.when(F.col("length") % width == 0, F.col("length") / width).otherwise(F.raise_error(F.concat(F.lit("not a multiple of the id width: "), "path"))).cast("long").alias("n"))
    cut = sized.filter("n > 0").select("file", "path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block_tokens}"))).alias("block"))
    return cut.select("file", "path", "block", (F.col("block") * block_tokens).alias("start"), F.least(F.lit(block_tokens), F.col("n") - F.col("block") * block_tokens).alias("length"))


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, nth, n_tokens, complete): the documents of all token files in folder, the end id not counted."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = _open(r["path"])
                with store.open_input_file(path) as f:
                    raw = f.read_at(r["length"] * width, r["start"] * width)
                at = np.flatnonzero(np.frombuffer(raw, dtype=f"<u{width}") == end_id) + r["start"]
                row = {"file": r["file"], "block": r["block"], "stop": r["start"] + r["length"], "n": len(at), "last": int(at[-1]) if len(at) else None, "places": at}
                yield pa.RecordBatch.from_pylist([row], schema=_found)

    _found = pa.schema([("file", pa.string()), ("block", pa.int64()), ("stop", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("places", pa.list_(pa.int64()))])
    n_blocks = blocks(spark, folder, width, block_tokens)
    found = materialize(n_blocks.repartition("file", "block").mapInArrow(search, "file string, block long, stop long, n long, last long, places array<long>"), "separators")
    # The scan runs over one small row a block; a file of a terabyte has some hundred thousand.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("file", "block", "stop", "n", "last").withColumns({"seen": F.coalesce(F.sum("n").over(before), F.lit(0)), "carry": F.coalesce(F.max("last").over(before), F.lit(-1))})
    inside = found.filter("n > 0").select("file", "block", "places").join(scanned.select("file", "block", "seen", "carry"), ["file", "block"])
    lengths = F.transform("places", lambda x, i: x - F.when(i == 0, F.col("carry")).otherwise(F.get("places", i - 1)) - 1)
    done = inside.select("file", "seen", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("seen") + F.col("i")).alias("nth"), "n_tokens", F.lit(True).alias("complete"))
    ends = scanned.groupBy("file").agg(F.max("stop").alias("stop"), F.sum("n").alias("nth"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    open_end = ends.select("file", "nth", (F.col("stop") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("complete")).filter("n_tokens > 0")
    return done.unionByName(open_end)


def document_token_counts(docs: DataFrame, tokenizer_path: str, end_id: int = 49407, width: int = 2) -> DataFrame:
    """Writes docs as token files in the shared folder and counts them back: doc_id, file, nth, n_tokens."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    order = write_token_files(docs, folder, tokenizer_path, end_id, width)
    return order.join(count_tokens(spark, folder, end_id, width), ["file", "nth"], "left").select("doc_id", "file", "nth", "n_tokens")
