"""Send-hour allocation under capacity limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import allocation as A
from tidemark.operators import search
from tidemark.plans.registry import Tables, query

_SCORES = """(SELECT user_id AS "user", CAST(hour(ts) AS INTEGER) AS "hour", round(avg(value), 6) AS score FROM events WHERE hour(ts) BETWEEN 9 AND 18 GROUP BY 1, 2)"""
# each user's best hour, with the hour's users in order: what one phase with ample capacity gives
_BEST = f"""(SELECT "user", "hour", score, row_number() OVER (PARTITION BY "hour" ORDER BY score DESC, "user") AS k FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, "hour") AS r FROM {_SCORES}) WHERE r = 1)"""


def scores(t: Tables) -> DataFrame:
    e = t.events.filter(F.hour("ts").between(9, 18))
    return e.groupBy(F.col("user_id").alias("user"), F.hour("ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("score"))


def capacity(s: DataFrame, share: float = 0.11) -> dict[int, int]:
    n = s.select("user").distinct().count()
    return {h: int(n * share) for h in range(9, 19)}


@query()
def q_greedy_allocation(t: Tables) -> DataFrame:
    s = scores(t)
    return A.greedy_allocation(s, capacity(s))


@query()
def q_batched_allocation(t: Tables) -> DataFrame:
    s = scores(t)
    cap = capacity(s)
    return A.batched_allocation(s, cap, max(1, sum(cap.values()) // 3))


@query()
def q_annealed_allocation(t: Tables) -> DataFrame:
    s = scores(t)
    return search.anneal_allocation(s, capacity(s))


@query()
def q_pareto_allocation(t: Tables) -> DataFrame:
    """The first front of a population of allocations: its objectives and the users of each hour."""
    s = scores(t)
    population, found = search.evolve(s, capacity(s), size=8, generations=2)
    order = sorted(found)
    front = [order[k] for k in search.fronts([found[i] for i in order])[0]]
    rows = t.spark.createDataFrame([(i, round(found[i][0], 6), round(found[i][1], 6)) for i in front], "individual int, cost double, spread double")
    return population.groupBy("individual", "hour").agg(F.count(F.lit(1)).alias("users")).join(F.broadcast(rows), "individual")


@query()
def q_exchange_allocation(t: Tables) -> DataFrame:
    s = scores(t)
    return A.improve_by_exchange(s, A.greedy_allocation(s, capacity(s)))


@query(f"""SELECT CAST(c.h AS INTEGER) AS "hour", 20 AS capacity, count(b."user") AS assigned, round(coalesce(sum(b.score), 0), 4) AS total, round(count(b."user") * 100.0 / 20, 4)::DOUBLE AS used_pct
FROM range(9, 19) c(h) LEFT JOIN {_BEST} b ON b."hour" = c.h GROUP BY c.h""")
def q_allocation_stats(t: Tables) -> DataFrame:
    best = scores(t).groupBy("user").agg(F.max(F.struct("score", (-F.col("hour")).alias("h"))).alias("p")).select("user", (-F.col("p.h")).alias("hour"), F.col("p.score").alias("score"))
    hours = t.spark.range(9, 19).select(F.col("id").cast("int").alias("hour"), F.lit(20).alias("capacity"))
    out = A.allocation_stats(best, hours)
    return out.select("hour", "capacity", "assigned", F.round("total", 4).alias("total"), F.round("used_pct", 4).alias("used_pct"))


@query(f"""SELECT CAST(c.h AS INTEGER) AS "hour", CAST(greatest(0, 20 - count(b."user")) AS BIGINT) AS left_over FROM range(9, 19) c(h) LEFT JOIN {_BEST} b ON b."hour" = c.h GROUP BY c.h""")
def q_leftover_capacity(t: Tables) -> DataFrame:
    best = scores(t).groupBy("user").agg(F.max(F.struct("score", (-F.col("hour")).alias("h"))).alias("p")).select((-F.col("p.h")).alias("hour"))
    hours = t.spark.range(9, 19).select(F.col("id").cast("int").alias("hour"))
    used = best.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    return hours.join(used, "hour", "left").select("hour", F.greatest(F.lit(0).cast("long"), 20 - F.coalesce("n", F.lit(0))).alias("left_over"))


@query(f"""SELECT coalesce(a."hour", b."hour") AS "hour", coalesce(a.n, 0) AS first_half, coalesce(b.n, 0) AS second_half, coalesce(b.n, 0) - coalesce(a.n, 0) AS diff
FROM (SELECT CAST(hour(ts) AS INTEGER) AS "hour", count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY 1) a FULL JOIN (SELECT CAST(hour(ts) AS INTEGER) AS "hour", count(*) AS n FROM events WHERE day(ts) > 15 GROUP BY 1) b ON a."hour" = b."hour" """)
def q_hour_diff(t: Tables) -> DataFrame:
    half = lambda c, n: t.events.filter(c).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias(n))
    both = half("day(ts) <= 15", "first_half").join(half("day(ts) > 15", "second_half"), "hour", "full").fillna(0)
    return both.withColumn("diff", F.col("second_half") - F.col("first_half"))
