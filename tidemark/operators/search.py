"""Randomised search over allocations: annealing of dealt groups, and an evolving population of whole allocations.

Users stay distributed: groups and genes are rows, the driver sees one row an hour or
one an individual.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.allocation import cut_lineage, greedy_allocation

#: Users of one group, about; a group is annealed in one task.
GROUP = 1_000
#: Proposals for each user of a group in one round.
TRIES = 12
# What an hour that is no option and a place beyond the capacity cost.
INVALID, OVER = 1000.0, 100.0


def _with_options(scores: DataFrame, hours: list[int], allocated: DataFrame) -> DataFrame:
    """(user, s, at): the scores in the order of hours and the number of the hour now, -1 for none."""
    at = [F.max(F.when(F.col("hour") == h, F.col("score"))) for h in hours]
    wide = scores.filter("score is not null").groupBy("user").agg(F.array(*at).alias("s"))
    place = F.create_map(*[F.lit(x) for k, h in enumerate(hours) for x in (h, k)])
    now = allocated.select("user", place[F.col("hour")].alias("at"))
    return wide.join(now, "user", "left").select("user", "s", F.coalesce("at", F.lit(-1)).alias("at"))


def anneal_group(s: np.ndarray, at: np.ndarray, free: np.ndarray, temperature: float, rng: np.random.Generator) -> np.ndarray:
    """One group's hours after its proposals: moves into its free places, else swaps with a user of the hour.

    s is nan where a user has no option, at is -1 for users without an hour. A move is
    taken if it gains, or with probability exp(gain / temperature); no move leaves an hour
    with more users than it had and free places were given.
    """
    at, free = at.copy(), free.copy()
    value = lambda i, h: 0.0 if h < 0 else s[i, h]
    members: list[list[int]] = [np.flatnonzero(at == h).tolist() for h in range(s.shape[1])]
    where = {i: k for m in members for k, i in enumerate(m)}
    options = [np.flatnonzero(~np.isnan(x)).tolist() for x in s]

    def leave(i: int) -> None:
        m, k = members[at[i]], where[i]
        m[k], where[m[-1]] = m[-1], k
        m.pop()

    def enter(i: int, h: int) -> None:
        at[i] = h
        where[i] = len(members[h])
        members[h].append(i)

    luck = lambda gain: gain > 0 or temperature > 0 and rng.random() < math.exp(max(gain / temperature, -60.0))
    for i in rng.integers(0, len(at), TRIES * len(at)).tolist():
        if not options[i]:
            continue
        h, a = options[i][int(rng.integers(len(options[i])))], int(at[i])
        if h == a:
            continue
        if free[h] > 0:
            if a < 0 or luck(value(i, h) - value(i, a)):
                if a >= 0:
                    leave(i)
                    free[a] += 1
                free[h] -= 1
                enter(i, h)
        elif members[h]:
            j = members[h][int(rng.integers(len(members[h])))]
            if a >= 0 and np.isnan(s[j, a]):
                continue
            gain = value(i, h) + value(j, a) - value(i, a) - value(j, h)
            if luck(gain) if a >= 0 else gain > 0:
                leave(j)
                if a >= 0:
                    leave(i)
                    enter(j, a)
                else:
                    at[j] = -1
                enter(i, h)
    return at


def _annealing(groups: int, free: list[int], heat: float, seed: int, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """anneal_group() on a group's rows (user, s, at, g), with its share of the free places of each hour."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        pdf = pdf.sort_values("user")
        mine = np.array([f // groups + ((g + j + k) % groups < f % groups) for j, f in enumerate(free)])
        s = np.array([[np.nan if x is None else x for x in row] for row in pdf["s"]], dtype=np.float64)
        pdf["at"] = anneal_group(s, pdf["at"].to_numpy(np.int64), mine, heat, np.random.default_rng([seed, k, g]))
        return pdf[["user", "s", "at"]]

    return run


def anneal_allocation(scores: DataFrame, capacity: dict[int, int], rounds: int = 8, seed: int = 42, start: float = 0.1, cooling: float = 0.4) -> DataFrame:
    """(user, hour, score): simulated annealing from the greedy allocation; the best round's result.

    Each round deals the users to groups anew, by a hash of user, seed and round, and
    gives each group its share of every hour's free places, so groups anneal by themselves
    and capacity holds. The temperature begins at ``start`` of the mean score, falls by
    ``cooling`` a round and is zero in the last one. The same seed gives the same result.
    """
    hours = sorted(h for h, c in capacity.items() if c > 0)
    first = cut_lineage(greedy_allocation(scores, capacity))
    if not hours:
        return first
    state = cut_lineage(_with_options(scores, hours, first))
    chosen = F.when(F.col("at") >= 0, F.element_at("s", F.greatest(F.col("at"), F.lit(0)) + 1)).otherwise(0.0)
    n, total, placed = state.agg(F.count(F.lit(1)), F.coalesce(F.sum(chosen), F.lit(0.0)), F.sum((F.col("at") >= 0).cast("int"))).first()
    best, best_key = state, (placed or 0, total)
    groups = max(1, -(-n // GROUP))
    kind = state.schema["user"].dataType.simpleString()
    for k in range(rounds):
        heat = 0.0 if k == rounds - 1 else start * abs(total) / max(1, n) * cooling**k
        used = {r["at"]: r["count"] for r in state.filter("at >= 0").groupBy("at").count().collect()}
        free = [capacity[h] - used.get(j, 0) for j, h in enumerate(hours)]

        dealt = state.withColumn("g", F.pmod(F.xxhash64("user", F.lit(seed), F.lit(k)), F.lit(groups)))
        state = cut_lineage(dealt.groupBy("g").applyInPandas(_annealing(groups, free, heat, seed, k), f"user {kind}, s array<double>, at int"))
        total, placed = state.agg(F.sum(chosen), F.sum((F.col("at") >= 0).cast("int"))).first()
        if (placed, total) > best_key:
            best, best_key = state, (placed, total)
    listed = F.array(*[F.lit(h) for h in hours])
    return best.filter("at >= 0").select("user", F.element_at(listed, F.col("at") + 1).cast(scores.schema["hour"].dataType).alias("hour"), chosen.alias("score"))


# evolving populations


def dominates(a: tuple, b: tuple) -> bool:
    """No objective worse, one better; all are minimised."""
    return all(x <= y for x, y in zip(a, b)) and a != b


def fronts(points: list[tuple]) -> list[list[int]]:
    """Indices by non-dominated front, the best first."""
    left, out = set(range(len(points))), []
    while left:
        front = sorted(i for i in left if not any(dominates(points[j], points[i]) for j in left))
        out.append(front)
        left -= set(front)
    return out


def crowding(points: list[tuple]) -> list[float]:
    """How far apart the neighbours of each point of a front are, summed over objectives; ends are infinitely far."""
    out = [0.0] * len(points)
    for k in range(len(points[0]) if points else 0):
        order = sorted(range(len(points)), key=lambda i: points[i][k])
        span = points[order[-1]][k] - points[order[0]][k]
        out[order[0]] = out[order[-1]] = math.inf
        for a, i, b in zip(order, order[1:], order[2:]):
            out[i] += (points[b][k] - points[a][k]) / span if span else 0.0
    return out


def best_ranked(points: list[tuple], n: int) -> list[int]:
    """The n survivors: whole fronts while they fit, then the least crowded of the next."""
    kept: list[int] = []
    for front in fronts(points):
        far = crowding([points[i] for i in front])
        kept += sorted(front, key=lambda i: -far[front.index(i)])[: n - len(kept)]
        if len(kept) == n:
            break
    return kept


def objectives(population: DataFrame, scores: DataFrame, capacity: dict[int, int]) -> dict[int, tuple[float, float]]:
    """individual -> (-score + penalties, spread of the use of hours + penalties), both to be minimised.

    population has (individual, user, hour). Hours that are no option of a user cost
    INVALID each, users beyond an hour's capacity OVER each.
    """
    use = population.join(scores.select("user", "hour", "score"), ["user", "hour"], "left").groupBy("individual", "hour").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.col("score").isNull().cast("int")).alias("bad"))
    seen: dict[int, list] = {}
    for r in use.collect():  # individuals x hours rows
        seen.setdefault(r["individual"], []).append(r)
    out = {}
    for i, rows in seen.items():
        n = {r["hour"]: r["n"] for r in rows}
        penalty = INVALID * sum(r["bad"] for r in rows) + OVER * sum(max(0, x - capacity.get(h, 0)) for h, x in n.items())
        load = [n.get(h, 0) / c for h, c in capacity.items() if c > 0]
        out[i] = (penalty - sum(r["s"] or 0.0 for r in rows), float(np.std(load)) + penalty)
    return out


def _chance(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def evolve(scores: DataFrame, capacity: dict[int, int], size: int = 12, generations: int = 4, islands: int = 2, mutation: float = 0.05, seed: int = 42, key: Callable[[tuple], tuple] | None = None) -> tuple[DataFrame, dict[int, tuple[float, float]]]:
    """The last population (individual, user, hour) and its objectives, by non-dominated sorting (NSGA-II).

    A gene is the row of a user in an individual. A child takes each gene from one of two
    parents, or a random option of the user, by hashes of user, child and seed, so making a
    generation is one join of the genes with the small table of parents. Islands choose
    parents among their own; each generation the best of each goes to the next one. One
    individual begins as the greedy allocation, users whom it leaves out at their best hour.

    ``key`` ranks by one tuple instead of fronts: with ``lambda o: (o[0],)`` it is a plain genetic search.
    """
    options = cut_lineage(scores.filter(F.col("score").isNotNull() & F.col("hour").isin(list(capacity))).groupBy("user").agg(F.array_sort(F.collect_list(F.struct("score", "hour"))).alias("o")))
    rng = np.random.default_rng(seed)
    pick = lambda *parts: F.element_at("o", (1 + F.floor(_chance(*parts) * F.size("o"))).cast("int"))["hour"]
    every = options.select("user", "o", F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("individual"))
    greedy = options.join(greedy_allocation(scores, capacity).select("user", "hour"), "user", "left").select(F.lit(0).alias("individual"), "user", F.coalesce("hour", F.element_at("o", -1)["hour"]).alias("hour"))
    population = cut_lineage(every.select("individual", "user", pick(F.col("user"), F.col("individual"), F.lit(seed)).alias("hour")).unionByName(greedy))
    found = objectives(population, scores, capacity)
    rank = key or (lambda o: o)
    for g in range(generations):
        mates = []
        for child in range(size, 2 * size):
            home = [i for i in sorted(found) if i % islands == child % islands] or sorted(found)
            pair = []
            for _ in range(2):  # of two the one that is not dominated
                a, b = (home[int(rng.integers(len(home)))] for _ in range(2))
                pair.append(b if dominates(rank(found[b]), rank(found[a])) else a)
            mates.append((child, *pair))
        spark = scores.sparkSession
        parents = spark.createDataFrame([(c, p, k) for c, a, b in mates for k, p in ((0, a), (1, b))], "child int, individual int, side int")
        side = F.when(_chance(F.col("user"), F.col("child"), F.lit(seed + g)) < 0.5, 0).otherwise(1)
        genes = population.join(F.broadcast(parents), "individual").filter(F.col("side") == side).join(options, "user")
        lucky = _chance(F.lit("m"), F.col("user"), F.col("child"), F.lit(seed + g)) < mutation
        children = genes.select(F.col("child").alias("individual"), "user", F.when(lucky, pick(F.lit("h"), F.col("user"), F.col("child"), F.lit(seed + g))).otherwise(F.col("hour")).alias("hour"))
        both = cut_lineage(population.unionByName(children))
        found |= objectives(both.filter(F.col("individual") >= size), scores, capacity)
        order = sorted(found)
        kept = [order[k] for k in best_ranked([rank(found[i]) for i in order], size)]
        # survivors are dealt to the islands round by round, so the best of one is met by the next
        number = {i: (k + g) % size for k, i in enumerate(kept)}
        named = spark.createDataFrame(list(number.items()), "individual int, _new int")
        population = cut_lineage(both.join(F.broadcast(named), "individual").select(F.col("_new").alias("individual"), "user", "hour"))
        found = {new: found[i] for i, new in number.items()}
    return population, found
