"""Optimal assignment of all users to hours under capacity, by prices per hour.

A transportation problem with many users and few hours. Three steps, none of which
gathers users on the driver:

1. Auction. Every user bids for the hour with the largest score less price. An hour
   that is asked for beyond its capacity raises its price by the margin that sends
   just the surplus away, found from a histogram of margins an hour, and by epsilon
   at least; epsilon is scaled down from phase to phase. Only prices are sent.
2. The exact greedy of this library turns the net scores at these prices into an
   assignment that respects every capacity.
3. Cycles. Moving a user from hour g to h gains a difference of scores. The driver
   gets the best few candidates of each pair of hours, at most hours^2 x CANDIDATES,
   applies gaining cycles among hours, and asks again until no cycle gains. The first
   candidates are exact, so then the assignment is optimal.

The potentials of the last round are prices for which the dual value, summed in one
pass over the users, bounds what any assignment can reach: its distance to the total
is the reported gap, zero but for rounding.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.allocation import cut_lineage, greedy_allocation

#: Candidates of a pair of hours that the driver sees in one round.
CANDIDATES = 200
#: Histogram buckets for each doubling of the margin.
STEPS = 8
#: Auction rounds of one phase; what is left over is the cycles' work.
ROUNDS = 25


class InfeasibleCapacity(ValueError):
    """No assignment gives every user an hour."""


@dataclass
class Optimum:
    """The assignment (user, hour, score), its total, and a bound that no assignment passes."""

    assigned: DataFrame
    total: float
    bound: float
    prices: dict[int, float]

    @property
    def gap(self) -> float:
        return self.bound - self.total


def _wide(scores: DataFrame, hours: list[int]) -> DataFrame:
    """(user, s): the score of each hour in the order of hours, null where the user has none."""
    at = [F.max(F.when(F.col("hour") == h, F.col("score"))) for h in hours]
    return scores.groupBy("user").agg(F.array(*at).alias("s"))


def _bids(s: Column, prices: list[float], leave: float) -> list[Column]:
    """The hour that a user wants (-1: none) and how far its price may rise before the user turns away."""
    net = F.array(*[F.struct((s[k] - F.lit(p)).alias("v"), F.lit(-k).alias("k")) for k, p in enumerate(prices)])
    some = F.concat(F.filter(net, lambda x: x["v"].isNotNull()), F.array(F.struct(F.lit(leave).alias("v"), F.lit(1).alias("k"))))
    ranked = F.reverse(F.array_sort(some))
    return [(-ranked[0]["k"]).alias("want"), (ranked[0]["v"] - F.get(ranked, F.lit(1))["v"]).alias("margin")]


def _auction(wide: DataFrame, room: list[int], span: float, leave: float) -> list[float]:
    """Prices at which each hour is asked for about as often as it has room."""
    prices = [0.0] * len(room)
    for eps in (span / 16, span / 256, span / 4096):
        for _ in range(ROUNDS):
            bid = wide.select(*_bids(F.col("s"), prices, leave)).filter("want >= 0")
            bucket = F.when(F.col("margin") <= eps, 0).otherwise(1 + F.floor(STEPS * F.log2(F.col("margin") / eps))).alias("b")
            seen: dict[int, list[tuple[int, int]]] = {}
            for r in bid.groupBy("want", bucket).count().collect():
                seen.setdefault(r["want"], []).append((r["b"], r["count"]))
            raised = False
            for k, counts in seen.items():
                surplus = sum(n for _, n in counts) - room[k]
                if surplus <= 0:
                    continue
                for b, n in sorted(counts):
                    surplus -= n
                    if surplus <= 0:
                        break
                prices[k] += max(eps, eps * 2 ** ((b - 1) / STEPS)) if b else eps
                raised = True
            if not raised:
                break
    return prices


def _candidates(state: DataFrame, n_hours: int) -> list:
    """The best users of each pair (hour now, other hour) by what the move gains; hour -1 is no hour, of score 0."""
    score = lambda k: F.when(k < 0, F.lit(0.0)).otherwise(F.element_at("s", F.greatest(k, F.lit(0)) + 1))
    target = F.explode(F.transform(F.sequence(F.lit(-1), F.lit(n_hours - 1)), lambda k: F.struct(k.alias("to"), score(k).alias("v"))))
    moves = state.select("user", "s", "at", target.alias("t")).filter("t.v is not null and t.to <> at")
    gain = F.col("t.v") - F.when(F.col("at") < 0, F.lit(0.0)).otherwise(F.element_at("s", F.col("at") + 1))
    each = moves.select("user", "s", "at", F.col("t.to").alias("to"), gain.alias("gain"))
    first = F.row_number().over(Window.partitionBy("at", "to").orderBy(F.desc("gain"), "user"))
    return each.withColumn("_n", first).filter(F.col("_n") <= CANDIDATES).collect()


class _Hours:
    """The hours as nodes; an arc's weight is the gain of its best candidate."""

    def __init__(self, rows: list, room: list[int], used: list[int], reward: float):
        self.n, self.room, self.used, self.reward = len(room), room, list(used), reward
        self.now: dict = {}
        self.scores: dict = {}
        self.heaps: dict[tuple[int, int], list] = {}
        for r in rows:
            self.now[r["user"]] = r["at"]
            self.scores[r["user"]] = r["s"]
        for u in self.now:
            self._offer(u)
        self.moved: dict = {}

    def value(self, user, at: int) -> float:
        return 0.0 if at < 0 else self.scores[user][at] + self.reward

    def _offer(self, user) -> None:
        at = self.now[user]
        for k in range(-1, self.n):
            if k != at and (k < 0 or self.scores[user][k] is not None):
                heapq.heappush(self.heaps.setdefault((at, k), []), (-(self.value(user, k) - self.value(user, at)), user))

    def best(self, a: int, b: int):
        heap = self.heaps.get((a, b), [])
        while heap and self.now[heap[0][1]] != a:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def arcs(self) -> list[tuple[int, int, float]]:
        """Node -2 is free room: an hour with a place left leads to it, and it leads to every hour; node -1 is no hour."""
        out = []
        for (a, b) in list(self.heaps):
            if top := self.best(a, b):
                out.append((a, b, -top[0]))
        for k in range(self.n):
            if self.used[k] < self.room[k]:
                out.append((k, -2, 0.0))
            out.append((-2, k, 0.0))
        out += [(-2, -1, 0.0), (-1, -2, 0.0)]  # no hour is always full and always has room
        return out

    def longest(self) -> tuple[dict[int, float], list[tuple[int, int]] | None]:
        """Potentials of the nodes by gain, or a cycle that gains."""
        nodes = [-2, -1, *range(self.n)]
        far, came = dict.fromkeys(nodes, 0.0), {}
        arcs, last = self.arcs(), None
        for _ in range(len(nodes) + 1):
            last = None
            for a, b, w in arcs:
                if far[a] + w > far[b] + 1e-9:
                    far[b], came[b], last = far[a] + w, a, b
            if last is None:
                return far, None
        for _ in nodes:
            last = came[last]
        cycle, v = [], last
        while True:
            cycle.append((came[v], v))
            v = came[v]
            if v == last:
                return far, cycle

    def improve(self) -> int:
        """Applies gaining cycles until there is none among the candidates; the number of cycles."""
        done = 0
        while (cycle := self.longest()[1]) is not None:
            moves = [(self.best(a, b)[1], b) for a, b in cycle if a != -2 and b != -2]
            for user, b in moves:
                a = self.now[user]
                if a >= 0:
                    self.used[a] -= 1
                if b >= 0:
                    self.used[b] += 1
                self.now[user] = self.moved[user] = b
            for user, _ in moves:
                self._offer(user)
            done += 1
        return done


def optimal_allocation(scores: DataFrame, capacity: dict[int, int], everyone: bool = True) -> Optimum:
    """The assignment of largest total score with every user in one of its hours and no hour over its capacity.

    scores has (user, hour, score), null scores are no choices; of repeated pairs the best
    counts. With everyone, capacity that can't hold all users raises InfeasibleCapacity;
    without, as many users as possible get an hour, and of those assignments the best is
    returned. Hours without an entry in capacity have no room. An empty table gives none.
    """
    spark = scores.sparkSession
    hours = sorted(h for h, c in capacity.items() if c > 0)
    room = [capacity[h] for h in hours]
    known = scores.filter("user is not null and score is not null")
    wide = cut_lineage(_wide(known, hours))
    n, low, high = wide.agg(F.count(F.lit(1)), F.min(F.array_min("s")), F.max(F.array_max("s"))).first()
    if everyone and n > sum(room):
        raise InfeasibleCapacity(f"{n} users, capacity {sum(room)}")
    if not n or low is None:
        if everyone and n:
            raise InfeasibleCapacity("no user has an hour with room")
        return Optimum(spark.createDataFrame([], scores.select("user", "hour", "score").schema), 0.0, 0.0, {h: 0.0 for h in hours})
    span = max(high - low, 1e-6)
    reward = (len(hours) + 1) * span + max(0.0, -low) + 1.0  # an hour, whichever, is worth more than any chain of moves
    prices = _auction(wide, room, span, -reward)
    index = {h: k for k, h in enumerate(hours)}
    # net scores at the prices, shifted so that all count; the greedy then keeps within every capacity
    net = wide.select("user", F.explode(F.array(*[F.struct(F.lit(h).alias("hour"), (F.col("s")[k] - prices[k]).alias("score")) for h, k in index.items()])).alias("o")).select("user", "o.hour", "o.score")
    first = greedy_allocation(net, {h: room[k] for h, k in index.items()}).select("user", "hour")
    place = F.create_map(*[F.lit(x) for h, k in index.items() for x in (h, k)])
    state = cut_lineage(wide.join(first, "user", "left").select("user", "s", F.coalesce(place[F.col("hour")], F.lit(-1)).alias("at")))
    while True:
        used = [0] * len(room)
        for r in state.filter("at >= 0").groupBy("at").count().collect():
            used[r["at"]] = r["count"]
        graph = _Hours(_candidates(state, len(hours)), room, used, reward)
        if not graph.improve():
            break
        moved = spark.createDataFrame(list(graph.moved.items()), f"user {state.schema['user'].dataType.simpleString()}, _to int")
        state = cut_lineage(state.join(F.broadcast(moved), "user", "left").select("user", "s", F.coalesce("_to", "at").alias("at")))
    missing = state.filter("at < 0").count()
    if everyone and missing:
        raise InfeasibleCapacity(f"{missing} of {n} users can't have an hour of theirs")
    far = graph.longest()[0]
    price = [max(0.0, far[k] - far[-2]) for k in range(len(hours))]
    best = F.array_max(F.array(F.lit(0.0), *[F.coalesce(F.col("s")[k] + F.lit(reward - price[k]), F.lit(0.0)) for k in range(len(hours))]))
    total, bound = state.agg(F.sum(F.when(F.col("at") >= 0, F.element_at("s", F.col("at") + 1)).otherwise(0.0)), F.sum(best)).first()
    bound = bound + sum(p * c for p, c in zip(price, room)) - reward * (n - missing)
    listed = F.array(*[F.lit(h) for h in hours])
    out = state.filter("at >= 0").select("user", F.element_at(listed, F.col("at") + 1).cast(scores.schema["hour"].dataType).alias("hour"), F.element_at("s", F.col("at") + 1).alias("score"))
    return Optimum(out, total, bound, dict(zip(hours, price)))


def hybrid_allocation(scores: DataFrame, capacity: dict[int, int], choices: int) -> DataFrame:
    """(user, hour, score, how): the optimum over each user's best hours, then greedy for the rest.

    The optimum sees ``choices`` hours of each user; users whom it leaves out take, by the
    greedy order, what is left of the capacity, over all their hours.
    """
    nth = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "hour"))
    best = scores.filter("score is not null").withColumn("_n", nth).filter(F.col("_n") <= choices).drop("_n")
    first = cut_lineage(optimal_allocation(best, capacity, everyone=False).assigned)
    used = {r["hour"]: r["count"] for r in first.groupBy("hour").count().collect()}
    left = {h: c - used.get(h, 0) for h, c in capacity.items()}
    rest = greedy_allocation(scores.join(first.select("user"), "user", "left_anti"), left)
    return first.withColumn("how", F.lit("optimum")).unionByName(rest.withColumn("how", F.lit("greedy")))
