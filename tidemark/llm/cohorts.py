"""Cohort retention from compressed, chunked bitmaps of dense client ids.

The clients with a start get the numbers 0, 1, 2 ... in the order of their ids. A
cell (state, segment, cohort, period) keeps its clients as a bitmap in chunks of
128 numbers: a row for each chunk that has any client, and in it only the 32-bit
words that are not zero. Chunks are merged by OR, so cells of several inputs, or of
parts of one, can be put together (``merge_cells``) without counting a client twice.

* users: popcount of the cell's bitmap.
* moved: popcount of its intersection with the bitmap of clients that have a start in
  the first and in the last state but not in the same cohort. That bitmap comes from
  the states' cohort bitmaps: OR over cohorts of each state, AND of the two, less
  the OR over cohorts of the AND inside a cohort.
* users_crc32: each set bit looks up the CRC of its client in the chunk's list.

A state knows the clicks that arrive before its cutoff; the states are nested, and
a state without a cutoff knows all. Numbers come from ranges of client ids: the
driver adds up one count a range. Clicks join starts by client with both sides
written, so Spark can split a client with a third of all clicks; cells and chunks
are folded before they are sent.

Defined cases: equal rows of clicks count once; a click without time or client is
dropped; one without an arrival is known only to states without a cutoff; a null
value adds 0 cents, NaN too; a client without a start has no cells; a client with
several rows has the segment of its latest one (greatest segment on ties), null
or none is ''; empty tables give no rows; other columns of clients are ignored,
other columns of clicks tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Bits of a word and words of a chunk.
WORD, WORDS = 32, 4
CHUNK = WORD * WORDS
CELL = ["state", "segment", "cohort", "period"]
_B = [f"b{k}" for k in range(WORDS)]


def dense_ids(starts: DataFrame) -> DataFrame:
    """starts with ``id``: 0, 1, 2 ... in the order of client_id, which is unique."""
    spark = starts.sparkSession
    placed = materialize(starts.repartitionByRange(partitions(spark), "client_id").withColumn("_part", F.spark_partition_id()), "cohort-ranges")
    base, rows = 0, []  # one row a range: bounded by the number of partitions, not by the input
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        rows.append((r["_part"], base))
        base += r["count"]
    bases = spark.createDataFrame(rows, "_part int, _base long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("client_id"))
    return placed.join(F.broadcast(bases), "_part").withColumn("id", F.col("_base") + rank - 1).drop("_part", "_base")


def _bits(identity: Column) -> list[Column]:
    """The words of a chunk that holds one number."""
    at = F.pmod(identity, F.lit(CHUNK)).cast("int")
    one = F.expr("1L")
    return [F.when(F.floor(at / WORD) == k, F.call_function("shiftleft", one, at % WORD)).otherwise(0).cast("long").alias(b) for k, b in enumerate(_B)]


def _ored(columns: list[str] = _B) -> list[Column]:
    return [F.bit_or(b).alias(b) for b in columns]


def compress(cells: DataFrame) -> DataFrame:
    """Replaces the words of a chunk by ``bits``, the list of its words that are not zero."""
    words = F.array(*[F.struct(F.lit(k).alias("word"), F.col(b).alias("bits")) for k, b in enumerate(_B)])
    return cells.withColumn("bits", F.filter(words, lambda x: x["bits"] != 0)).drop(*_B)


def merge_cells(*parts: DataFrame) -> DataFrame:
    """Chunks of equal cells as one, by OR; cents are added."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    word = lambda k: F.coalesce(F.aggregate(F.filter("bits", lambda x: x["word"] == k), F.expr("0L"), lambda a, x: a.bitwiseOR(x["bits"])), F.expr("0L"))
    loose = whole.select(*CELL, "chunk", "cents", *[word(k).alias(b) for k, b in enumerate(_B)])
    return compress(loose.groupBy(*CELL, "chunk").agg(*_ored(), F.sum("cents").alias("cents")))


def cohort_starts(clicks: DataFrame, clients: DataFrame, n_states: int) -> DataFrame:
    """(client_id, id, segment, start_0 ... ): the first known start of each client in each state."""
    seg = F.max(F.struct("updated_at", "segment"))["segment"]
    segments = materialize(clients.filter("client_id is not null").groupBy("client_id").agg(F.coalesce(seg, F.lit("")).alias("segment")), "cohort-segments")
    firsts = [F.min(F.when(F.col("known_from") <= s, F.col("ts"))).alias(f"start_{s}") for s in range(n_states)]
    starts = materialize(clicks.filter("begins").groupBy("client_id").agg(*firsts), "cohort-starts")
    return dense_ids(starts.join(segments, "client_id", "left").withColumn("segment", F.coalesce("segment", F.lit(""))))


def prepare(clicks: DataFrame, arrival: Column, cutoffs: list[str | None], kind: str) -> DataFrame:
    """(client_id, ts, begins, cents, known_from) of the distinct clicks; known_from is the first state that knows the click."""
    known = F.lit(None).cast("int")
    for s, cut in reversed(list(enumerate(cutoffs))):
        known = F.lit(s) if cut is None else F.when(arrival < F.lit(cut).cast("timestamp_ntz"), s).otherwise(known)
    cents = F.floor(100 * F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)) + 0.5)
    whole = clicks.filter("ts is not null and client_id is not null").distinct()
    return whole.select("client_id", "ts", (F.col("kind").eqNullSafe(kind)).alias("begins"), cents.cast("long").alias("cents"), known.alias("known_from")).filter("known_from is not null")


def cell_bitmaps(clicks: DataFrame, starts: DataFrame, n_states: int, cohort_days: int = 1, period_days: int = 1) -> DataFrame:
    """(state, segment, cohort, period, chunk, bits, cents): the compressed chunks of every cell."""
    states = F.filter(
        F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"start_{s}").alias("start")) for s in range(n_states)]),
        lambda x: (F.col("known_from") <= x["state"]) & (F.col("ts") >= x["start"]),
    )
    seen = clicks.join(starts, "client_id").select("segment", "ts", "cents", "id", F.explode(states).alias("s"))
    days = F.expr("cast(extract(DAY FROM ts - s.start) as long)")
    cells = seen.select(
        F.col("s.state").alias("state"), "segment", _cohort(F.col("s.start"), cohort_days).alias("cohort"),
        F.floor(days / period_days).alias("period"), F.floor(F.col("id") / CHUNK).alias("chunk"), "cents", *_bits(F.col("id")),
    )
    return compress(cells.groupBy(*CELL, "chunk").agg(*_ored(), F.sum("cents").alias("cents")))


def _cohort(start: Column, days: int) -> Column:
    return F.floor(F.unix_date(start.cast("date")) / days).cast("long")


def moved_chunks(starts: DataFrame, n_states: int, cohort_days: int = 1) -> DataFrame:
    """(chunk, moved): words of the clients whose cohort in the last state differs from that in the first."""
    both = F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"start_{s}").alias("start")) for s in (0, n_states - 1)])
    rows = starts.select("id", F.explode(F.filter(both, lambda x: x["start"].isNotNull())).alias("s"))
    placed = rows.select(F.floor(F.col("id") / CHUNK).alias("chunk"), F.col("s.state").alias("state"), _cohort(F.col("s.start"), cohort_days).alias("cohort"), *_bits(F.col("id")))
    side = lambda s, b: F.coalesce(F.bit_or(F.when(F.col("state") == s, F.col(b))), F.expr("0L"))
    cohorts = placed.groupBy("chunk", "cohort").agg(*[side(s, b).alias(f"{b}_{k}") for k, s in enumerate((0, n_states - 1)) for b in _B])
    a, z, same = (lambda b: F.bit_or(f"{b}_0")), (lambda b: F.bit_or(f"{b}_1")), (lambda b: F.bit_or(F.col(f"{b}_0").bitwiseAND(F.col(f"{b}_1"))))
    moved = F.array(*[a(b).bitwiseAND(z(b)).bitwiseAND(F.bitwise_not(same(b))) for b in _B])
    return cohorts.groupBy("chunk").agg(moved.alias("moved"))


def crc_chunks(starts: DataFrame) -> DataFrame:
    """(chunk, crcs): the CRC of the decimal client_id at each place of a chunk; at most 128 a row."""
    entry = F.struct(F.pmod("id", F.lit(CHUNK)).alias("at"), F.crc32(F.col("client_id").cast("string").cast("binary")).alias("crc"))
    listed = starts.groupBy(F.floor(F.col("id") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return listed.select("chunk", F.col("e.crc").alias("crcs"))


#: The places of the set bits of a word below 2^32: the lowest set bit is cleared once for each.
_LOOKUP = f"""aggregate(bits, 0L, (total, x) -> total + aggregate(sequence(1, bit_count(x.bits)), named_struct('left', x.bits, 's', 0L),
  (a, i) -> named_struct('left', a.left & (a.left - 1), 's', a.s + crcs[x.word * {WORD} + bit_count((a.left & -a.left) - 1)]), a -> a.s))"""


def retention(clicks: DataFrame, clients: DataFrame, arrival: Column, cutoffs: list[str | None], kind: str = "signup", cohort_days: int = 1, period_days: int = 1) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved and cents of every cell that is not empty."""
    n = len(cutoffs)
    if not n or None in cutoffs[:-1]:
        raise ValueError("cutoffs ascend, and only the last may be None")
    narrow = materialize(prepare(clicks, arrival, cutoffs, kind), "cohort-clicks")
    starts = materialize(cohort_starts(narrow, clients, n), "cohort-ids")
    cells = materialize(cell_bitmaps(narrow, starts, n, cohort_days, period_days), "cohort-cells")
    chunks = materialize(moved_chunks(starts, n, cohort_days).join(crc_chunks(starts), "chunk"), "cohort-chunks")
    counted = cells.join(chunks, "chunk").select(
        *CELL, "cents",
        F.expr("aggregate(bits, 0L, (n, x) -> n + bit_count(x.bits))").alias("users"),
        F.expr(_LOOKUP).alias("users_crc32"),
        F.expr("aggregate(bits, 0L, (n, x) -> n + bit_count(x.bits & moved[x.word]))").alias("moved"),
    )
    return counted.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("users", "users_crc32", "moved", "cents")])
