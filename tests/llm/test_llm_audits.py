"""Cohort bitmaps, the filter audit and toxic spans against plain loops, and their defined cases."""

import math
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import FIELDS, LONG, odd_rows

from tidemark.llm import cohorts, filter_audit, queries, toxicity

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, updated_at timestamp_ntz, segment string"
DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(odd_rows(), FIELDS)
    return d.withColumns({n: F.lit(7) for n in ("score", "held_out", "part", "mask", "bits", "sha", "least", "y", "spans", "cells")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


# cohorts


def click_rows(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        ts = DAY + timedelta(microseconds=int(rng.integers(0, 20 * 86400 * 10**6)))
        client = 7 if i % 3 == 0 else int(rng.integers(0, 700)) * 1_000_003
        rows.append((i, ts, ts + timedelta(days=int(rng.integers(0, 12))), client, str(rng.choice(["signup", "view", "buy"])), float(np.round(rng.normal(3, 9), 2)), "{}"))
    ts = DAY + timedelta(days=3)
    rows += [rows[5], rows[5], (None, ts, ts, 9, "signup", None, None), (1, None, ts, 9, "signup", 1.0, ""), (2, ts, ts, None, "signup", 1.0, "")]
    rows += [(3, ts, None, 9, "view", math.nan, ""), (4, ts, ts, 9, None, -0.005, "a"), (4, ts, ts, 9, None, -0.005, "b"), (None, None, None, None, None, None, None)]
    return rows


def client_rows():
    return [(7, DAY, "old"), (7, DAY + timedelta(1), "a"), (7, DAY + timedelta(1), "b"), (9, None, None), (None, DAY, "x"), *[(k * 1_000_003, DAY, "ab"[k % 2] if k % 5 else None) for k in range(600)]]


def cells_by_loop(rows, clients, cutoff, cohort_days=1, period_days=1):
    segment = {}
    for c, at, s in clients:
        if c is not None:
            segment[c] = max(segment.get(c, (datetime.min, "")), (at or datetime.min, s or ""))
    known = [[r for r in set((*x[:5], None if x[5] is not None and math.isnan(x[5]) else x[5], x[6]) for x in rows) if r[1] and r[3] is not None and (s or r[2] and r[2] < cutoff)] for s in (0, 1)]
    start = [{}, {}]
    for s in (0, 1):
        for r in known[s]:
            if r[4] == "signup":
                start[s][r[3]] = min(start[s].get(r[3], r[1]), r[1])
    cohort = lambda t: (t.date() - datetime(1970, 1, 1).date()).days // cohort_days
    moved = {c for c in start[0] if cohort(start[0][c]) != cohort(start[1][c])}
    users, cents = defaultdict(set), Counter()
    for s in (0, 1):
        for r in known[s]:
            a = start[s].get(r[3])
            if a and r[1] >= a:
                key = s, segment.get(r[3], (0, ""))[1], cohort(a), (r[1] - a) // timedelta(days=period_days)
                users[key].add(r[3])
                cents[key] += math.floor(100 * (r[5] or 0) + 0.5)
    return {(*k, len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(u & moved), cents[k]) for k, u in users.items()}


@pytest.mark.parametrize("days", [(1, 1), (7, 3)])
def test_retention_equals_plain_loops(spark, days):
    rows, clients = click_rows(6000, 1), client_rows()
    got = cohorts.retention(spark.createDataFrame(rows, CLICKS), spark.createDataFrame(clients, CLIENTS), F.col("arrived_at"), ["2024-01-10 00:00:00", None], cohort_days=days[0], period_days=days[1])
    want = cells_by_loop(rows, clients, datetime(2024, 1, 10), *days)
    assert {tuple(r) for r in got.select(*cohorts.CELL, "users", "users_crc32", "moved", "cents").collect()} == want
    assert any(w[6] for w in want) and got.count() == len(want)


def test_retention_of_nothing(spark):
    clicks, clients = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert cohorts.retention(clicks, clients, F.col("arrived_at"), ["2024-01-10 00:00:00", None]).count() == 0
    with pytest.raises(ValueError, match="ascend"):
        cohorts.retention(clicks, clients, F.col("arrived_at"), [None, "2024-01-10 00:00:00"])


def test_cells_merge_by_or(spark):
    """Chunks of two halves of the clicks, put together, equal those of the whole."""
    narrow = cohorts.prepare(spark.createDataFrame(click_rows(3000, 2), CLICKS), F.col("arrived_at"), [None], "signup").cache()
    starts = cohorts.cohort_starts(narrow, spark.createDataFrame(client_rows(), CLIENTS), 1)
    assert sorted(r.id for r in starts.collect()) == list(range(starts.count()))
    half = F.xxhash64("ts", "cents") % 2 == 0
    plain = lambda d: sorted((*r[:4], r.chunk, r.cents, tuple((x.word, x.bits) for x in r.bits)) for r in d.select(*cohorts.CELL, "chunk", "cents", "bits").collect())
    whole = plain(cohorts.cell_bitmaps(narrow, starts, 1))
    assert plain(cohorts.merge_cells(cohorts.cell_bitmaps(narrow.filter(half), starts, 1), cohorts.cell_bitmaps(narrow.filter(~half), starts, 1))) == whole
    assert all(0 < b < 1 << 32 for r in whole for _, b in r[6])


def test_chunks_are_sent_folded(spark):
    plan = cohorts.cell_bitmaps(*(spark.createDataFrame([], s) for s in ("client_id long, ts timestamp_ntz, begins boolean, cents long, known_from int", "client_id long, id long, segment string, start_0 timestamp_ntz")), 1)
    assert "partial_bit_or" in plan._jdf.queryExecution().executedPlan().toString()


# filter audit


def fails(text):
    text = text or ""
    w = text.encode().split()
    return [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text)]


def audit_by_loop(rows, labels):
    out = Counter()
    for d, t, _, part, _ in rows:
        same = any(x[0] is not None and d is not None and x[0] < d and (x[1] or "") == (t or "") for x in rows)
        failed = "".join(c for c, f in zip("ABCDE", [*fails(t), same]) if f)
        good, toxic = (any(x is not None and x == d and y[k] == 1 for x, *y in labels) for k in (0, 1))
        for order in permutations("ABCDE"):
            gone = False
            for step, c in enumerate(order, 1):
                hit = c in failed
                key = part or "", "".join(order), step
                for name, n in (("kept", not gone and not hit), ("removed", hit and not gone), ("redundant", hit and gone), ("unique_fails", failed == c), ("good_lost", hit and not gone and good), ("toxic_lost", hit and not gone and toxic)):
                    out[*key, name] += n
                out[part or "", c, "shapley"] += hit and not gone
                gone = gone or hit
    return out


def test_audit_equals_plain_loops(spark, odd, none):
    labels = [(1, 1, 0), (2, 1, None), (2, 0, 1), (4, None, 1), (7, 0, 1), (None, 1, 1), (8, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    want = audit_by_loop(odd_rows(), labels)
    rows = filter_audit.audit(odd, table).collect()
    assert len(rows) == 600 * len({r[3] or "" for r in odd_rows()})
    for r in rows:
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[r.part, r.filter_order, r.step, name]
        assert r.shapley == want[r.part, r.filter_order[r.step - 1], "shapley"]
    assert filter_audit.audit(none, table).count() == 0
    assert filter_audit.audit(odd, table.limit(0)).filter("good_lost > 0 or toxic_lost > 0").count() == 0


def test_parity_sums_invert_exactly(spark):
    rng = np.random.default_rng(4)
    rows = [("p", int(m), bool(g), bool(x)) for m, g, x in zip(rng.integers(0, 32, 500), rng.integers(0, 2, 500), rng.integers(0, 2, 500))]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"))
    got = {r.label: r.cells for r in filter_audit.mask_cells(sums).collect()}
    for label, keep in (("all", lambda r: True), ("good", lambda r: r[2]), ("toxic", lambda r: r[3])):
        n = Counter(r[1] for r in rows if keep(r))
        assert got[label] == [n[m] for m in range(32)]
    first = sums.filter("label = 'all'").first()
    assert first["s0"] == 500 and first["s5"] == sum((-1) ** (r[1] & 5).bit_count() for r in rows)


# toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    lens = np.array([5, 1, 0, 8, 3])
    e, tr = rng.normal(0, 2, int(lens.sum())), rng.normal(0, 1, (2, 2))
    p, pairs = toxicity.forward_backward(e, lens, tr)
    want, pair, at = [], np.zeros((2, 2)), 0
    for n in lens:
        paths = list(product((0, 1), repeat=int(n)))
        w = np.array([math.exp(sum(e[at + i] for i in range(n) if y[i]) + sum(tr[a, b] for a, b in zip(y, y[1:]))) for y in paths])
        w /= w.sum()
        want += [sum(x for x, y in zip(w, paths) if y[i]) for i in range(n)]
        for x, y in zip(w, paths):
            for a, b in zip(y, y[1:]):
                pair[a, b] += x
        at += n
    assert p == pytest.approx(want) and pairs == pytest.approx(pair)
    long, _ = toxicity.forward_backward(np.zeros(30_000), np.array([30_000]), tr)
    assert np.isfinite(long).all()


def test_stems_share_features():
    w = toxicity._tokens([b"Badstem1 badstem22 other", "é, bad".encode()])
    f = toxicity.features(w)
    assert w.count.tolist() == [3, 2]
    assert f[0, toxicity.PREFIXES.index(7) + 1] == f[1, toxicity.PREFIXES.index(7) + 1] != f[2, 0]
    assert (f[4] == f[4, 0]).sum() == len(toxicity.PREFIXES) + 1  # no prefix is shorter than the token


def toxic_corpus(spark, n=600):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocabulary, int(rng.integers(5, 80))))
        bad = i % 5 == 0
        if bad:
            for k in rng.integers(0, len(w), 3):
                w[k] = f"vile{rng.integers(0, 50)}"
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows)


def test_spans_and_scores(spark):
    docs, labels, texts = toxic_corpus(spark)
    chain = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 0)
    rows = toxicity.score(docs, chain, F.col("doc_id") % 4 == 0).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in rows if r.held_out]) > 0.97
    found = [(texts[r.doc_id][s.start : s.stop], s.marginal) for r in rows for s in r.spans]
    assert sum(all(w.startswith("vile") for w in t.split()) for t, _ in found) > 0.95 * len(found) > 200
    assert all(m >= 0.5 for _, m in found)


def test_offsets_are_code_points():
    raw = "né é vile, ßx vile vile".encode()
    w = toxicity._tokens([raw])
    p = np.array([x.startswith(b"vile") for x in (raw[a:b] for a, b in zip(w.start, w.stop))], float)
    assert [raw.decode()[s["start"] : s["stop"]] for s in toxicity._spans(raw, w.start, w.stop, p)] == ["vile", "vile vile"]


def test_toxicity_of_odd_rows(spark, odd, none):
    docs, labels, _ = toxic_corpus(spark)
    chain = toxicity.fit(docs, labels, F.lit(True))
    rows = toxicity.score(odd, chain).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and not r.held_out for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score(none, chain).count() == 0
    for y in (labels.limit(0), labels.filter("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        flat = toxicity.fit(docs, y, F.lit(True))
        assert {r.score for r in toxicity.score(odd, flat).collect()} == {1.0 if y.filter("toxic = 1").count() else 0.5}


def test_marginals_of_a_long_text_are_local(spark):
    """A toxic word far inside a long text is found at its place; nothing is cut off."""
    docs, labels, _ = toxic_corpus(spark)
    chain = toxicity.fit(docs, labels, F.lit(True))
    text = LONG + " vile1 vile2 vile3 " + LONG
    (r,) = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), chain).collect()
    assert any("vile2" in text[s.start : s.stop] for s in r.spans)


def test_op13_held_out_accuracy(spark, sf_dir):
    rows = queries.queries()["op13_crf_toxicity"](spark, sf_dir).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {r.doc_id for r in rows} == docs and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    known = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([r.predicted == labels[r.doc_id] for r in known]) > 0.8
