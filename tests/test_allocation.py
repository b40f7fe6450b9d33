"""Optimal and hybrid allocation against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import optimal, search
from tidemark.operators.allocation import greedy_allocation

SCORES = "user string, hour int, score double"


def table(spark, scores):
    return spark.createDataFrame([(f"u{u}", h, s) for u, mine in scores.items() for h, s in mine.items()], SCORES)


def best_by_trying(scores, cap):
    """(users, total) of the best assignment: most users first, then the largest total."""
    best = (0, 0.0)
    for pick in itertools.product(*[[None, *scores[u]] for u in scores]):
        if all(pick.count(h) <= cap.get(h, 0) for h in set(pick) - {None}):
            got = [scores[u][h] for u, h in zip(scores, pick) if h is not None]
            best = max(best, (len(got), sum(got)))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_optimum_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(optimal, "ROUNDS", 3)  # the cycles do the rest
    r = random.Random(seed)
    hours = range(9, 9 + r.randint(2, 3))
    scores = {u: {h: r.randint(-2, 9) / 3 for h in hours if r.random() < 0.8} for u in range(6)}
    scores = {u: s for u, s in scores.items() if s}
    cap = {h: r.randint(0, 3) for h in hours}
    users, total = best_by_trying(scores, cap)
    got = optimal.optimal_allocation(table(spark, scores), cap, everyone=False)
    rows = got.assigned.collect()
    assert len({x.user for x in rows}) == len(rows) == users
    assert all(sum(x.hour == h for x in rows) <= cap[h] for h in hours)
    assert all(scores[int(x.user[1:])][x.hour] == x.score for x in rows)
    assert sum(x.score for x in rows) == pytest.approx(total) == got.total
    assert got.gap == pytest.approx(0, abs=1e-6)
    if users < len(scores):
        with pytest.raises(optimal.InfeasibleCapacity):
            optimal.optimal_allocation(table(spark, scores), cap)


def test_optimum_of_many_users(spark, monkeypatch):
    """More users than candidates: the bound proves the optimum, which beats greedy; a chain of moves is found."""
    monkeypatch.setattr(optimal, "CANDIDATES", 5)
    r = random.Random(1)
    scores = {u: {h: round(r.random() ** 2 + (h == 10) * 0.3, 6) for h in range(9, 14) if r.random() < 0.7 or h == 13} for u in range(800)}
    cap = {9: 170, 10: 100, 11: 170, 12: 170, 13: 200}
    frame = table(spark, scores)
    got = optimal.optimal_allocation(frame, cap)
    assert got.assigned.count() == 800 and got.gap == pytest.approx(0, abs=1e-6)
    assert all(r["count"] <= cap[r["hour"]] for r in got.assigned.groupBy("hour").count().collect())
    greedy = greedy_allocation(frame, cap)
    assert greedy.count() < 800 or got.total > greedy.agg(F.sum("score")).first()[0]
    assert min(got.prices.values()) >= 0


def test_infeasible_and_empty(spark):
    frame = table(spark, {0: {9: 1.0}, 1: {9: 2.0}, 2: {10: 1.0}})
    with pytest.raises(optimal.InfeasibleCapacity):
        optimal.optimal_allocation(frame, {9: 1, 10: 5})
    with pytest.raises(optimal.InfeasibleCapacity):
        optimal.optimal_allocation(frame, {11: 5})
    assert optimal.optimal_allocation(frame.limit(0), {9: 1}).assigned.count() == 0
    kept = optimal.optimal_allocation(frame, {9: 1, 10: 5}, everyone=False).assigned.collect()
    assert sorted(map(tuple, kept)) == [("u1", 9, 2.0), ("u2", 10, 1.0)]


def test_hybrid_fills_what_is_left(spark):
    scores = {u: {9: 1.0 - u / 100, 10: 0.5 - u / 100, 11: 0.1} for u in range(9)}
    rows = optimal.hybrid_allocation(table(spark, scores), {9: 3, 10: 3, 11: 2}, choices=2).collect()
    assert {h: sum(x.hour == h for x in rows) for h in (9, 10, 11)} == {9: 3, 10: 3, 11: 2}
    assert {x.how for x in rows if x.hour == 11} == {"greedy"} and sum(x.how == "optimum" for x in rows) == 6
    assert len({x.user for x in rows}) == 8


# randomised search


def test_a_group_keeps_its_places():
    rng = np.random.default_rng(3)
    s = rng.random((60, 4))
    s[rng.random(s.shape) < 0.3] = np.nan
    at = np.array([next((h for h in rng.permutation(4) if not np.isnan(s[i, h])), -1) if i % 5 else -1 for i in range(60)])
    free = np.array([2, 0, 1, 0])
    room = np.bincount(at[at >= 0], minlength=4) + free
    value = lambda x: sum(s[i, h] for i, h in enumerate(x) if h >= 0)
    cold = search.anneal_group(s, at, free, 0.0, np.random.default_rng(1))
    assert value(cold) >= value(at) and (np.bincount(cold[cold >= 0], minlength=4) <= room).all()
    hot = search.anneal_group(s, at, free, 5.0, np.random.default_rng(1))
    assert (np.bincount(hot[hot >= 0], minlength=4) <= room).all() and not np.isnan([s[i, h] for i, h in enumerate(hot) if h >= 0]).any()
    assert (search.anneal_group(s, at, free, 5.0, np.random.default_rng(1)) == hot).all()


def test_annealing_holds_capacity_and_beats_greedy(spark, monkeypatch):
    monkeypatch.setattr(search, "GROUP", 60)
    r = random.Random(2)
    scores = {u: {h: round(r.random() + (h == 9) * 0.4, 6) for h in range(9, 13) if r.random() < 0.8} or {9: 0.5} for u in range(200)}
    cap = {9: 50, 10: 50, 11: 50, 12: 60}
    frame = table(spark, scores)
    greedy = greedy_allocation(frame, cap)
    first, again = (sorted(map(tuple, search.anneal_allocation(frame, cap, rounds=3, seed=5).collect())) for _ in range(2))
    assert first == again and len({u for u, _, _ in first}) == len(first) >= greedy.count()
    assert all(sum(x[1] == h for x in first) <= cap[h] for h in cap)
    assert all(scores[int(u[1:])][h] == s for u, h, s in first)
    assert len(first) > greedy.count() or sum(x[2] for x in first) >= greedy.agg(F.sum("score")).first()[0]
    assert search.anneal_allocation(frame, {}).count() == 0


def test_fronts_equal_pairwise_dominance():
    r = random.Random(7)
    points = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(40)]
    got = search.fronts(points)
    assert sorted(i for f in got for i in f) == list(range(40))
    left = set(range(40))
    for f in got:
        assert set(f) == {i for i in left if not any(points[j][0] <= points[i][0] and points[j][1] <= points[i][1] and points[j] != points[i] for j in left)}
        left -= set(f)
    assert search.crowding([(0, 4), (1, 2), (3, 0), (2, 1)])[:3] == [float("inf"), 2 / 3 + 3 / 4, float("inf")]
    assert len(search.best_ranked(points, 7)) == 7


def test_population_evolves(spark):
    r = random.Random(3)
    scores = {u: {h: round(r.random(), 6) for h in range(9, 12)} for u in range(40)}
    cap, frame = {9: 15, 10: 15, 11: 15}, table(spark, scores)
    population, found = search.evolve(frame, cap, size=6, generations=2)
    rows = population.collect()
    assert len(rows) == 6 * 40 and len({(x.individual, x.user) for x in rows}) == 240
    for i, (cost, spread) in found.items():
        mine = {x.user: x.hour for x in rows if x.individual == i}
        n = {h: sum(v == h for v in mine.values()) for h in cap}
        over = 100.0 * sum(max(0, n[h] - cap[h]) for h in cap)
        assert cost == pytest.approx(over - sum(scores[int(u[1:])][h] for u, h in mine.items()))
        assert spread == pytest.approx(np.std([n[h] / cap[h] for h in cap]) + over)
    greedy = greedy_allocation(frame, cap).agg(F.sum("score")).first()[0]
    assert min(c for c, _ in found.values()) <= -greedy + 1e-9
    single = search.evolve(frame, cap, size=6, generations=2, key=lambda o: (o[0],))[1]
    assert min(c for c, _ in single.values()) <= -greedy + 1e-9
