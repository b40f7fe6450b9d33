"""Band joins, sketches, tag patterns, alignment, stateful streams, catalog and database tables, table functions, depths, selection."""

import random
import re
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import similarity as S
from tidemark.functions.tables import NgramSpans, chunked
from tidemark.functions.tags import TagAutomaton, tag_spans, tags_kept
from tidemark.functions.text import chunk
from tidemark.operators import graph, selection
from tidemark.operators.bands import band_aggregate, band_join
from tidemark.operators.sketches import merged, quantiles, sketch
from tidemark.plans import registry
from tidemark.sources import catalog
from tidemark.streaming import stateful


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# band joins


@pytest.mark.parametrize(("low", "high", "width"), [(0, 0, None), (1, 7, None), (-3, 4, 2.0), (1, 50, 1000.0), (-9, -2, 0.7)])
def test_band_join_equals_all_pairs(spark, low, high, width):
    r = random.Random(high)
    rows = lambda n: [(None if r.random() < 0.05 else r.choice("aab"), None if r.random() < 0.05 else float(r.choice([r.randint(-30, 30), r.random() * 9])), k) for k in range(n)]
    a, b = rows(120), rows(150)
    left, right = (spark.createDataFrame(x, "k string, at double, id int") for x in (a, b))
    got = band_join(left, right, ["k"], "at", low, high, width)
    want = sorted((x[2], y[2]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[1] is not None and y[1] is not None and low <= x[1] - y[1] <= high)
    assert sorted((p.id, p.r_id) for p in got.collect()) == want
    assert not re.search("NestedLoop|Cartesian", plan_of(got))


def test_band_aggregate(spark):
    rows = [("a", d, v) for d, v in ((1, 5.0), (1, 7.0), (4, 1.0), (9, 2.0), (10, 3.0))] + [("b", 3, 9.0)]
    df = spark.createDataFrame(rows, "k string, at int, v double")
    got = band_aggregate(df, df, ["k"], "at", 1, 6, {"n": F.count("v"), "s": F.sum("v")}, {"n": F.sum("r_n"), "s": F.sum("r_s")})
    assert sorted(map(tuple, got.collect())) == [("a", 4, 2, 12.0), ("a", 9, 1, 1.0), ("a", 10, 2, 3.0)]
    with pytest.raises(ValueError, match="below"):
        band_join(df, df, ["k"], "at", 2, 1)


# sketches


def test_sketches_merge(spark):
    r = random.Random(2)
    values = [r.gauss(0, 5) ** 3 for _ in range(20_000)] + [0.0] * 4000
    df = spark.createDataFrame([(k % 7, "g", v) for k, v in enumerate(values)] + [(0, "g", None), (0, "g", float("nan"))], "day int, g string, v double")
    daily = sketch(df, ["g", "day"], "v")
    assert "partial_kll" in plan_of(daily)
    got = quantiles(merged(daily, ["g"]), ["g"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()
    values.sort()
    for x in got:
        assert x.n == len(values)
        low, high = sum(v < x.value for v in values) / len(values), sum(v <= x.value for v in values) / len(values)
        assert low - 0.03 <= x.p <= high + 0.03
    assert {x.p: x.value for x in got}[0.0] == values[0] and {x.p: x.value for x in got}[1.0] == values[-1]


# tag patterns


def spans_by_loop(tags, pattern, gap):
    out, i = [], 0
    while i < len(tags):
        j, pos, miss = i, 0, 0
        while j < len(tags) and pos < len(pattern):
            if tags[j] == pattern[pos]:
                pos, miss = pos + 1, 0
            else:
                miss += 1
                if pos == 0 or miss > gap:
                    break
            j += 1
        if pos == len(pattern):
            out.append((i, j - 1))
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_automaton_equals_a_search(spark, gap):
    r = random.Random(gap)
    patterns = [["A", "B"], ["B", "A", "C"], ["A", "A"], ["C"]]
    texts = [[r.choice("ABCD") if r.random() < 0.97 else None for _ in range(r.choice([0, 1, 5, 40]))] for _ in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tags array<string>")
    got = {x.id: x.spans for x in df.select("id", tag_spans(patterns, gap)("tags").alias("spans")).collect()}
    for k, tags in enumerate(texts):
        if tags is None:
            assert got[k] is None
            continue
        want = [(p, a, b) for p, pattern in enumerate(patterns) for a, b in spans_by_loop(tags, pattern, gap)]
        assert [tuple(s) for s in got[k]] == want


def test_tags_kept_equals_a_search(spark):
    r = random.Random(9)
    patterns = [["D"], ["A", "B"], ["B", "B", "B"]]
    texts = [[r.choice("ABCD") for _ in range(r.choice([0, 3, 30]))] for _ in range(40)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tags array<string>").coalesce(1)
    for x in df.select("id", "tags", tags_kept(patterns)("tags").alias("keep")).collect():
        if x.tags is None:
            assert x.keep is None
            continue
        gone = {i + j for p in patterns for i in range(len(x.tags)) if x.tags[i : i + len(p)] == p for j in range(len(p))}
        assert x.keep == [i not in gone for i in range(len(x.tags))]


def test_automaton_is_one_table():
    auto = TagAutomaton([["A", "B"], ["A", "C"]], 2)
    assert auto.table.shape[1] == 4 and auto.longest == 4
    with pytest.raises(ValueError, match="empty"):
        TagAutomaton([[]])


# alignment


def test_alignments_equal_the_plain_table(spark):
    r = random.Random(4)
    lists = lambda: [[r.choice("abcd") for _ in range(r.choice([0, 1, 2, 9, 40]))] if r.random() < 0.95 else None for _ in range(700)]
    a, b = lists(), lists()
    got = S.alignments(pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string())))
    for x, y, s in zip(a, b, got):
        assert (s != s) if x is None or y is None else s == pytest.approx(S.alignment(x, y))


def test_token_alignment_query(spark, sf_dir):
    turns = {(x.conv_id, x.turn): (x.text or "").lower().split() for x in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    rows = registry.queries()["q_token_alignment"](spark, sf_dir).collect()
    assert len(rows) == sum((c, t - 1) in turns for c, t in turns) > 0
    for x in rows:
        assert x.alignment == pytest.approx(S.alignment(turns[x.conv_id, x.turn - 1], turns[x.conv_id, x.turn]), abs=1e-8)


# streams


def event_rows(n, seed):
    r, at = random.Random(seed), datetime(2024, 1, 1)
    return [(k, r.randint(0, 4), at + timedelta(seconds=r.randint(0, 90_000)), "view" if r.random() < 0.6 else "buy", float(r.randint(0, 9))) for k in range(n)]


EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"


def sessions_by_loop(rows, gap):
    out = []
    for u in {x[1] for x in rows}:
        for _, _, ts, _, v in sorted((x for x in rows if x[1] == u), key=lambda x: x[2]):
            ms = round((ts - datetime(1970, 1, 1)).total_seconds() * 1000)
            if out and out[-1][0] == u and ms - out[-1][2] < 1000 * gap:
                out[-1] = (u, out[-1][1], ms, out[-1][3] + 1, out[-1][4] + v)
            else:
                out.append((u, ms, ms, 1, v))
    return out


def test_sessions_restart_from_the_checkpoint(spark, tmp_path):
    """Three parts of the rows in three starts of one stream give what all rows give; late rows are dropped."""
    rows = sorted(event_rows(300, 5), key=lambda x: x[2])
    parts, folder = [rows[:100], rows[100:200], rows[200:]], tmp_path / "in"
    plan = lambda: stateful.closed_sessions(spark.readStream.schema(EVENTS).parquet(f"{folder}"), 600, "30 minutes")
    for k, part in enumerate(parts):
        more = [(9000, 2, datetime(2023, 12, 1), "view", 1.0)] * (k == 2)  # far below the watermark by then
        r = random.Random(k)
        spark.createDataFrame(r.sample(part, len(part)) + more, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}")
        stateful.run_available(spark, plan, f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted((x.user_id, x.start_ms, x.last_ms, x.n, x.total) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    end = max(s[2] for s in sessions_by_loop(rows, 600)) - 1_800_000
    want = sorted(s for s in sessions_by_loop(rows, 600) if s[2] + 600_000 <= end)
    assert got == want and len(want) > 20


class HeldState:
    """A handle, its list state and the timer's values, which count what is written."""

    def __init__(self):
        self.rows, self.timers, self.writes, self.watermark = [], set(), 0, 0

    def getListState(self, name, schema):
        return self

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.writes = list(rows), self.writes + 1

    def clear(self):
        self.put([])

    def registerTimer(self, ms):
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    getExpiryTimeInMs = getCurrentWatermarkInMs


@pytest.mark.parametrize("seed", range(3))
def test_sessions_read_a_users_state_once_a_batch(seed):
    """Many sessions of one user in few batches: the state is written twice a batch at most, and no session stays behind."""
    r, held, out = random.Random(seed), HeldState(), []
    sessions = stateful.Sessions(1000)
    sessions.init(held)
    times = sorted(r.randint(0, 2_000_000) for _ in range(1500))
    for k in range(0, 1500, 300):
        part = r.sample(times[k : k + 300], 300)
        assert list(sessions.handleInputRows((1,), iter([Row(user_id=1, ts=None, ms=ms, value=1.0) for ms in part]), held)) == []
        held.watermark = max(times[: k + 300]) - 500 if k < 1200 else 3_000_000
        while due := [t for t in held.timers if t <= held.watermark]:
            held.timers.remove(min(due))
            out += [tuple(x) for x in sessions.handleExpiredTimer((1,), held, held)]
    want = stateful.merge_sessions([(ms, ms, 1, 1.0) for ms in times], 1000)
    assert sorted(x[1:] for x in out) == want and len(want) > 300 and held.rows == []
    assert held.writes <= 10


def test_sessions_merge_in_any_order():
    assert stateful.merge_sessions([(50, 60, 1, 1.0), (0, 10, 2, 2.0), (55, 58, 1, 0.5), (15, 40, 1, 1.0)], 10) == [(0, 40, 3, 3.0), (50, 60, 2, 1.5)][:0] + [(0, 40, 3, 3.0), (50, 60, 2, 1.5)]


def test_stream_join_equals_batch(spark, tmp_path):
    rows = event_rows(300, 6)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    got = stateful.stream_to_table(spark, lambda: stateful.attributed(read().filter("event_type = 'view'"), read().filter("event_type = 'buy'"), "10 minutes", "1 hour"))
    want = {(a[1], a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[3] == "view" and b[3] == "buy" and timedelta(0) <= b[2] - a[2] <= timedelta(minutes=10)}
    assert {(x.user_id, x.first_id, x.then_id) for x in got.collect()} == want and want


# catalog and database


def test_catalog_reads_only_its_partitions(spark):
    df = spark.createDataFrame([(k, f"n{k}", f"2024{k % 5 + 1:02d}") for k in range(50)], "id int, name string, ym string")
    catalog.save_partitioned(df, "tm_months", ["ym"])
    try:
        assert catalog.described(spark, "tm_months") == ["id", "name", "ym"]
        got = catalog.read_months(spark, "tm_months", ["name as item", "missing", "id", "id"], "ym", ["202401", "202403"])
        assert got.columns == ["item", "id"] and got.count() == 20
        plan = plan_of(got)
        assert re.search(r"PartitionFilters: \[.*ym.*IN", plan) and "PushedFilters: []" in plan
        files = {f.split("ym=")[1][:6] for f in got.inputFiles()}
        assert files == {"202401", "202403"}
        catalog.save_partitioned(df.filter("ym = '202401'").withColumn("name", F.lit("new")).limit(3), "tm_months", ["ym"])
        assert spark.table("tm_months").count() == 43 and spark.table("tm_months").filter("name = 'new'").count() == 3
        assert catalog.read_months(spark, "tm_months", ["id"], "ym", []).count() == 0
    finally:
        spark.sql("DROP TABLE tm_months")


def test_database_reads_are_split_and_filtered(spark):
    """An in-memory Derby database, which comes with Spark."""
    url, driver = "jdbc:derby:memory:tidemark;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k, f"{'2025' if k % 2 else '2024'}{k:04d}", f"p{k}", "N" if k % 3 else "Y", "APPR" if k % 5 else "WAIT", "Y", f"clue {k}" if k % 7 else None, "PR"[k % 2]) for k in range(200)]
    df = spark.createDataFrame(rows, "n int, cmpgn_pgm_num string, pgm_nm string, del_yn string, aprv_op_rslt_cd string, exps_yn string, rmk string, item_dmn string")
    df = df.toDF(*[c.upper() for c in df.columns])  # names that need no quotes in the database
    df.write.jdbc(url, "programs", mode="overwrite", properties={**driver, "createTableColumnTypes": "CMPGN_PGM_NUM varchar(20), PGM_NM varchar(20), DEL_YN varchar(1), APRV_OP_RSLT_CD varchar(8), EXPS_YN varchar(1), ITEM_DMN varchar(1)"})
    got = catalog.programs(spark, url, "programs", "2025", split="n", parts=4, **driver)
    assert got.columns[0] == "n" and got.rdd.getNumPartitions() == 4
    want = {r[0] for r in rows if r[1].startswith("2025") and r[3] == "N" and r[4] == "APPR" and r[6]}
    assert {r.n for r in got.collect()} == want
    assert catalog.items(spark, url, "programs", **driver).count() == catalog.organisations(spark, url, "programs", **driver).count() == 100
    narrow = catalog.read_database(spark, url, "programs", **driver).filter("n > 190").select("pgm_nm")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(N,190\)", plan_of(narrow)) and narrow.count() == 9


# table functions


def test_table_functions(spark):
    texts = [(1, "one two three. four five\n\nsix " * 9), (2, ""), (3, None), (4, "x" * 50)]
    df = spark.createDataFrame(texts, "id long, body string")
    got = chunked(df, "id", "body", 40, 5).collect()
    for i, t in texts:
        mine = sorted((r.chunk, r.body) for r in got if r.id == i)
        assert [b for _, b in mine] == chunk(t or "", 40, 5)
    spans = NgramSpans(df.asTable().partitionBy("id")).collect()
    assert {(r.word_from, r.word_to) for r in spans if r.id == 4} == {(0, 0)} and not [r for r in spans if r.id in (2, 3)]
    assert sum(r.id == 1 for r in spans) == sum(len(texts[0][1].split()) - k for k in (0, 1, 2))


# graphs


def test_depths(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "y"), ("z", "end"), ("a", "end"), ("a", "b")]
    got = {r.node: r.depth for r in graph.depths(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "x": 0, "y": None, "z": None, "end": None}
    assert not graph.is_acyclic(spark.createDataFrame(edges, "src string, dst string"))
    assert graph.is_acyclic(spark.createDataFrame(edges[:4], "src string, dst string"))
    with pytest.raises(RuntimeError, match="levels"):
        graph.depths(spark.createDataFrame(edges[:4], "src string, dst string"), max_rounds=1)


# model selection


def test_folds_hold_keys_together(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("user"))
    folds = df.select("user", selection.fold([F.col("user")], 4, 7).alias("f")).distinct()
    assert folds.count() == 300 and folds.select("f").distinct().count() == 4
    assert folds.exceptAll(df.select("user", selection.fold([F.col("user")], 4, 8).alias("f")).distinct()).count() > 100
