"""Global ranks and exact capacity-constrained greedy allocation without driver-side rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.session import shared_root

#: Buckets of one counting step of the rank search; the driver sees hours x buckets rows.
BUCKETS = 512


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 over the whole of df, without a single-task window.

    Rows are range-partitioned; the driver adds up one count a partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    base, rows = 0, []
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        rows.append((r["_part"], base))
        base += r["count"]
    bases = spark.createDataFrame(rows, "_part int, _base long")
    inside = Window.partitionBy("_part").orderBy(*order)
    return placed.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.row_number().over(inside)).drop("_part", "_base")


def _first_full(chosen: DataFrame, capacity: dict[int, int], low: int, high: int) -> tuple[int | None, dict[int, int]]:
    """The least rank from low to high at which some hour reaches its capacity, and the users of each hour up to there.

    Found by counting in ever finer rank buckets; None where no hour is filled.
    """
    width, seen = high - low + 1, dict.fromkeys(capacity, 0)
    while True:
        step = max(1, -(-width // BUCKETS))
        part = chosen.filter(F.col("rank").between(low, low + width - 1))
        got: dict[int, dict[int, int]] = {}
        for r in part.groupBy("hour", F.expr(f"(rank - {low}) div {step}").alias("b")).count().collect():
            got.setdefault(r["b"], {})[r["hour"]] = r["count"]
        for b in sorted(got):
            full = any(seen[h] + n >= capacity[h] for h, n in got[b].items())
            if full and step > 1:
                low, width = low + b * step, step
                break
            for h, n in got[b].items():
                seen[h] += n
            if full:
                return low + b, seen
        else:
            return None, seen


def greedy_allocation(scores: DataFrame, capacity: dict[int, int]) -> DataFrame:
    """(user, hour, score): users in order of their best score take their best hour that has room.

    scores has (user, hour, score), one row a pair; null scores are no choices. Ties:
    user ascending, hour ascending. Equal to the serial loop, in at most
    len(capacity) + 1 phases: all users up to the first rank that fills an hour are
    final, and only the full hours change what the others choose.

    A user is one row with the options in order, written once. A phase only counts what
    that row gives with the hours still open; the result is one pass over the rows in
    which each user's phase tells the open hours.
    """
    room = {h: c for h, c in capacity.items() if c > 0}
    known = scores.filter(F.col("score").isNotNull())
    # the order comes from all hours, those without room included
    entry = F.when(F.col("hour").isin(list(room)), F.struct((-F.col("score")).alias("cost"), F.col("hour").alias("hour"), F.col("score").alias("score")))
    users = known.groupBy("user").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(entry)).alias("o"))
    base = cut_lineage(global_rank(users, [F.desc("best"), F.asc("user")], "rank").select("user", "rank", "o"))
    n, low = base.count(), 1
    first = lambda hours: F.get(F.filter("o", lambda x: x["hour"].isin(hours)), F.lit(0))
    phases: list[tuple[int, list[int]]] = []
    while room and low <= n:
        hours = sorted(room)
        chosen = base.filter(F.col("rank") >= low).select("rank", first(hours)["hour"].alias("hour")).filter("hour is not null")
        stop, used = _first_full(chosen, room, low, n)
        phases.append((n if stop is None else stop, hours))
        if stop is None:
            break
        room = {h: c - used[h] for h, c in room.items() if c > used[h]}
        low = stop + 1
    if not phases:
        return scores.sparkSession.createDataFrame([], scores.select("user", "hour", "score").schema)
    pick = F.lit(None)
    for stop, hours in reversed(phases):
        pick = F.when(F.col("rank") <= stop, first(hours)).otherwise(pick)
    return base.select("user", pick.alias("p")).filter("p is not null").select("user", "p.hour", "p.score")


def batched_allocation(scores: DataFrame, capacity: dict[int, int], batch: int) -> DataFrame:
    """Greedy over batches of users by best score; each batch sees only the hours still open."""
    best = scores.groupBy("user").agg(F.max("score").alias("best"))
    ranked = cut_lineage(global_rank(best, [F.desc("best"), F.asc("user")], "r").select("user", F.expr(f"(r - 1) div {batch}").alias("batch_id")))
    last = ranked.agg(F.max("batch_id")).first()[0]
    room, done = dict(capacity), None
    for b in range(0 if last is None else last + 1):
        part = scores.join(ranked.filter(F.col("batch_id") == b), "user").drop("batch_id")
        out = cut_lineage(greedy_allocation(part, room))
        for r in out.groupBy("hour").count().collect():
            room[r["hour"]] -= r["count"]
        done = out if done is None else done.unionByName(out)
    return greedy_allocation(scores, {}) if done is None else done


def improve_by_exchange(scores: DataFrame, allocated: DataFrame, rounds: int = 3) -> DataFrame:
    """Local search in place of annealing: pairs of users swap hours while the sum of scores grows.

    Users are dealt into small groups by hash; each group improves by itself, so
    capacity use per hour never changes.
    """
    import pandas as pd

    n_groups = max(1, allocated.count() // 200)
    for k in range(rounds):
        dealt = allocated.select("user", "hour").withColumn("g", F.pmod(F.xxhash64("user", F.lit(k)), F.lit(n_groups)))
        rows = scores.withColumnRenamed("hour", "option").join(dealt, "user")

        def swap(pdf: pd.DataFrame) -> pd.DataFrame:
            table = pdf.pivot_table(index="user", columns="option", values="score", aggfunc="max")
            now = pdf.drop_duplicates("user").set_index("user")["hour"].to_dict()
            users = sorted(now)
            get = {(u, h): s for u, row in zip(table.index, table.to_dict("records")) for h, s in row.items() if s == s}
            for i, a in enumerate(users):
                for b in users[i + 1 :]:
                    ha, hb = now[a], now[b]
                    if ha != hb and (a, hb) in get and (b, ha) in get and get[a, hb] + get[b, ha] > get[a, ha] + get[b, hb] + 1e-12:
                        now[a], now[b] = hb, ha
            return pd.DataFrame({"user": users, "hour": [now[u] for u in users], "score": [get[u, now[u]] for u in users]})

        kinds = {f.name: f.dataType.simpleString() for f in scores.schema}
        allocated = cut_lineage(rows.groupBy("g").applyInPandas(swap, f"user {kinds['user']}, hour {kinds['hour']}, score {kinds['score']}"))
    return allocated


def allocation_stats(allocated: DataFrame, capacity: DataFrame) -> DataFrame:
    """Per hour: capacity, users, use in percent and score; hours without users included."""
    per = allocated.groupBy("hour").agg(F.count(F.lit(1)).alias("assigned"), F.sum("score").alias("total"))
    joined = capacity.join(per, "hour", "left").fillna({"assigned": 0, "total": 0.0})
    return joined.withColumn("used_pct", F.col("assigned") * 100.0 / F.col("capacity"))
