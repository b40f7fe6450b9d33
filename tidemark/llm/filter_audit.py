"""How five filters overlap, audited through Walsh-Hadamard sums of failure masks.

Every document gets a mask of the filters that it fails. For each part and label, 32
sums of signs (-1)^popcount(mask & s) are aggregated; the transform is its own
inverse up to a factor, so the sums give the number of documents of each of the 32
masks exactly. All orders of the filters follow from these cells: with P the
filters before a step, the step meets the documents whose mask avoids P. A document
that fails k filters is removed by each of them in 120 / k of the 120 orders, which
gives the Shapley value in closed form.

Rows are folded to 32 sums a part and label inside each task before any exchange, so
a part with a third of all rows costs one row a task. The identity filter looks up
the least doc_id of a text's SHA-256; both sides of its join are written, so Spark
can split a text that many rows share.

Defined cases: a null text is the empty one, a null source is the part ''; a row without
doc_id has no smaller doc_id and never fails the identity filter, nor does its id
make others fail; repeated rows count each; labels of one doc_id count as their
maximum, null as none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Each document counts under the first label, and under the others where they hold.
LABELS = ("all", "good", "toxic")
_WHITE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> list[Column]:
    """The conditions of A to D on a text that is not null."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every row; bit k of mask: the k-th filter fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures(text))), F.lit(0))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("sha")), "audit-rows")
    least = materialize(rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("sha", "least"), "audit-texts")
    same = F.col("doc_id") > F.col("least")
    marked = rows.join(least, "sha", "left").withColumn("mask", F.col("bits") + F.when(same, 1 << 4).otherwise(0)).select("doc_id", "part", "mask")
    known = materialize(labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(c) == 1, F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]), "audit-labels")
    return materialize(marked, "audit-masks").join(known.hint("merge"), "doc_id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in LABELS[1:]])


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, label, s0 ... s31): the sums of signs of each part and label."""
    held = F.filter(F.array(*[F.when(F.lit(True) if name == "all" else F.col(name), F.lit(name)) for name in LABELS]), lambda x: x.isNotNull())
    sign = lambda s: 1 - 2 * F.bit_count(F.col("mask").bitwiseAND(s)).bitwiseAND(1)
    each = rows.select("part", "mask", F.explode(held).alias("label"))
    return each.groupBy("part", "label").agg(*[F.sum(sign(s)).alias(f"s{s}") for s in range(MASKS)])


def mask_cells(sums: DataFrame) -> DataFrame:
    """(part, label, cells): the number of documents of each mask, from the inverse transform."""
    sign = lambda m, s: 1 - 2 * ((m & s).bit_count() & 1)
    cell = lambda m: sum((sign(m, s) * F.col(f"s{s}") for s in range(MASKS)), F.lit(0)) / MASKS
    return sums.select("part", "label", F.array(*[cell(m).cast("long") for m in range(MASKS)]).alias("cells"))


def _steps() -> Column:
    """All steps of all orders: order, number, its filter's bit, and the bits of the filters before it."""
    rows = []
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            rows.append(f"struct('{order}', {k + 1}, {bit}, {before})")
            before |= bit
    return F.expr(f"cast(array({', '.join(rows)}) as array<struct<filter_order:string,step:int,bit:int,before:int>>)")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    cells = mask_cells(parity_sums(masks(docs, labels)))
    empty = F.expr(f"array_repeat(0L, {MASKS})")
    of = lambda name: F.coalesce(F.max(F.when(F.col("label") == name, F.col("cells"))), empty).alias(name)
    parts = cells.groupBy("part").agg(*[of(name) for name in LABELS])
    # documents of each label whose mask avoids the filters u, for every set u
    avoid = lambda name: F.expr(f"transform(sequence(0, {MASKS - 1}), u -> aggregate(sequence(0, {MASKS - 1}), 0L, (n, m) -> n + if((m & u) = 0, `{name}`[m], 0L)))")
    share = F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), k -> aggregate(sequence(1, {MASKS - 1}), 0L, (n, m) -> n + if((shiftright(m, k) & 1) = 1, `all`[m] * ({len(ORDERS)} div bit_count(m)), 0L)))")
    wide = parts.select("part", F.col("all").alias("cells"), share.alias("share"), *[avoid(name).alias(f"free_{name}") for name in LABELS])
    rows = wide.select("*", F.explode(_steps()).alias("t")).select("*", F.col("t.bit").alias("bit"), F.col("t.before").alias("before"), F.expr("t.before | t.bit").alias("after"))
    lost = lambda name: F.expr(f"free_{name}[before] - free_{name}[after]")
    return rows.select(
        "part", F.col("t.filter_order").alias("filter_order"), F.col("t.step").alias("step"),
        F.expr("free_all[after]").alias("kept"), lost("all").alias("removed"),
        F.expr("(free_all[0] - free_all[bit]) - (free_all[before] - free_all[after])").alias("redundant"),
        F.expr("cells[bit]").alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.expr("share[bit_count(bit - 1)]").alias("shapley"),
    )
