"""Operators without a SQL form, on literal fixtures and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import similarity as S
from tidemark.functions import text as X
from tidemark.operators import aliases as A
from tidemark.operators import allocation, features, graph, ranking
from tidemark.sources import files
from tidemark.streaming.events import run_to_table, tumbling


def serial_greedy(scores, capacity):
    best = {}
    for u, _, s in scores:
        best[u] = max(best.get(u, s), s)
    room, out = dict(capacity), {}
    for u in sorted(best, key=lambda u: (-best[u], u)):
        options = sorted((-s, h) for v, h, s in scores if v == u and room.get(h, 0) > 0)
        if options:
            out[u] = options[0][1]
            room[options[0][1]] -= 1
    return out


@pytest.mark.parametrize("seed,room", [(1, 3), (2, 30), (3, 0)])
def test_greedy_equals_the_serial_loop(spark, seed, room):
    r = random.Random(seed)
    scores = [(u, h, r.randint(1, 12) / 4) for u in range(40) for h in range(9, 14) if r.random() < 0.8]
    cap = {h: room + r.randint(0, 3) for h in range(9, 14)}
    df = spark.createDataFrame(scores, "user int, hour int, score double")
    assert {x.user: x.hour for x in allocation.greedy_allocation(df, cap).collect()} == serial_greedy(scores, cap)


def test_exchange_keeps_capacity_and_gains(spark):
    r = random.Random(4)
    scores = [(u, h, r.random()) for u in range(40) for h in range(9, 14)]
    df = spark.createDataFrame(scores, "user int, hour int, score double")
    before = allocation.greedy_allocation(df, {h: 8 for h in range(9, 14)})
    after = allocation.improve_by_exchange(df, before, rounds=1)
    use = lambda d: sorted((x["hour"], x["count"]) for x in d.groupBy("hour").count().collect())
    assert use(after) == use(before)
    total = lambda d: d.agg(F.sum("score")).first()[0]
    assert total(after) >= total(before) - 1e-9


def test_global_rank(spark):
    d = spark.createDataFrame([((i * 7919) % 500, i) for i in range(500)], "a int, b int")
    rows = allocation.global_rank(d, [F.desc("a"), F.asc("b")], "r").collect()
    want = sorted([(x.a, x.b) for x in rows], key=lambda x: (-x[0], x[1]))
    assert [(x.a, x.b) for x in sorted(rows, key=lambda x: x.r)] == want
    assert sorted(x.r for x in rows) == list(range(1, 501))


def test_metrics_on_literals():
    assert S.ratio("abcd", "abxd") == 0.75
    assert S.lcs_length("kitten", "sitting") == 4
    assert S.partial_ratio("bolt", "old bolt") == 1.0
    assert S.token_sort_ratio("small ring", "ring small") == 1.0
    assert S.token_set_ratio("small ring", "ring") == 1.0
    assert S.lcs_ratio("ring", "small ring", "s1") == 1.0
    assert S.substring_aware("ring", "ringring") == pytest.approx(0.975)
    assert S.alignment(["a", "b"], ["a", "b"]) == 1.0
    assert S.alignment(["a"], ["b"]) == 0.0


def test_lcs_equals_the_table():
    r = random.Random(5)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.lcs_length(a, b) == t[-1][-1]


def test_alias_expansion():
    rules = [("small", "tiny", "partial", "S"), ("tiny", "wee", "partial", "S"), ("RING", "band", "partial", "I"), ("x", "y", "exact", "S")]
    assert A.expand("small ring", rules) == ["small ring", "tiny ring", "small band", "wee ring", "tiny band", "wee band"]
    assert A.expand("small ring", rules, depth=1) == ["small ring", "tiny ring", "small band"]
    assert A.expand("x", rules) == ["x", "y"]
    assert A.expand("xx", rules) == ["xx"]


def test_chunks_always_advance():
    assert X.chunk("a b c d e f", 4, 1) and X.chunk("", 5, 1) == []
    text = "ab " * 200
    for size, overlap in ((10, 9), (10, 0), (7, 3)):
        parts = X.chunk(text, size, overlap)
        assert all(0 < len(p) <= size for p in parts)
    assert X.chunk("one.\n\ntwo three", 10, 0)[0] == "one."


def test_json_repair():
    assert X.repair_json("text {\"a\": 1, } more") == {"a": 1}
    assert X.repair_json("{a: 'x'}") == {"a": "x"}
    assert X.repair_json("none") is None


def test_span_resolution():
    m = lambda s, e, v, n="x": {"start": s, "end": e, "score": v, "entity": n}
    assert X.resolve_spans([m(0, 10, 95), m(2, 10, 92)]) == [m(0, 10, 95)]
    assert X.resolve_spans([m(0, 10, 95), m(2, 10, 92, "y")]) == [m(0, 10, 95), m(2, 10, 92, "y")]
    assert X.resolve_spans([m(0, 10, 95), m(1, 9, 50)]) == [m(0, 10, 95)]


def test_month_and_group_helpers():
    assert features.previous_months("202402", 3) == ["202312", "202401", "202402"]
    assert features.sliding_groups([1, 2, 3, 4, 5], 3, 2) == [[1, 2, 3], [3, 4, 5]]


def test_dict_filter_rules(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert features.dict_filter(d, {}).count() == 2
    with pytest.raises(KeyError):
        features.dict_filter(d, {"no": 1})
    with pytest.raises(ValueError):
        features.dict_filter(d, {"k": 1}, "XOR")


def test_lookback_directions(spark):
    d = spark.createDataFrame([("u", "2024-01-01", 5), ("u", "2024-03-01", 7)], "u string, m string, n int").withColumn("m", F.to_date("m"))
    back = {str(r.m): r.s for r in features.lookback(d, ["u"], "m", "n", 2, "s").collect()}
    assert back == {"2024-02-01": 5, "2024-03-01": 5, "2024-04-01": 7, "2024-05-01": 7}
    ahead = {str(r.m): r.s for r in features.lookback(d, ["u"], "m", "n", 1, "s", "forward").collect()}
    assert ahead == {"2023-12-01": 5, "2024-02-01": 7}


def test_undersampling_is_repeatable(spark):
    d = spark.range(2000).select("id", F.lit("k").alias("k"), (F.col("id") % 20 == 0).cast("int").alias("y"))
    a, b = (features.undersample(d, ["k"], "y", 3.0, F.col("id")) for _ in range(2))
    assert a.filter("y = 1").count() == 100
    assert 200 < a.filter("y = 0").count() < 400
    assert a.exceptAll(b).isEmpty()


def test_graph_with_a_cycle(spark):
    lines = spark.createDataFrame([("(A:x) -[r]-> (B:y)",), ("(B:y) -[r]-> (C:z)",), (" (B:y) -[r]-> (D:z) ",), ("(E:a)",), ("# path",), ("(P:1) -[r]-> (Q:1)",), ("(Q:1) -[r]-> (P:1)",)], "line string")
    e = graph.parse_edges(lines)
    assert {r.node for r in graph.parse_nodes(lines).collect()} == {"E:a"}
    assert {tuple(r.path) for r in graph.paths(e).collect()} == {("A:x", "B:y", "C:z"), ("A:x", "B:y", "D:z")}
    assert len({r.component for r in graph.components(e).collect()}) == 2


def test_sources(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes("이름,b\n가나다,1\n".encode("cp949"))
    got = files.read_csv_any(spark, f"file://{tmp_path}/k.csv")
    assert got.columns == ["이름", "b"] and got.first()[0] == "가나다"
    (tmp_path / "m.txt").write_text("a\\nb\n\n  \nc\\td\n")
    assert [r.message for r in files.read_lines(spark, f"file://{tmp_path}/m.txt").collect()] == ["a\nb", "c\td"]
    (tmp_path / "m.jsonl").write_text('{"message_id": "1", "message": "x"}\n{"id": "2", "text": "y"}\n')
    assert sorted(tuple(r) for r in files.read_jsonl(spark, f"file://{tmp_path}/m.jsonl").collect()) == [("1", "x"), ("2", "y")]
    d = spark.createDataFrame([(i, f"n{i}", "2024" if i < 12 else "2025", "01" if i % 2 else "02") for i in range(18)], "id int, name string, year string, month string")
    files.write_partitions(d, f"file://{tmp_path}/p", ["year", "month"])
    back = files.merge_partitions(spark, f"file://{tmp_path}/p")
    assert back.count() == 18 and dict(back.dtypes)["month"] == "string"
    files.write_partitions(d.filter("year = '2025'").withColumn("name", F.lit("new")), f"file://{tmp_path}/p", ["year", "month"])
    assert files.merge_partitions(spark, f"file://{tmp_path}/p").filter("name = 'new'").count() == 6


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run_to_table(tumbling(stream, "6 hours", "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")
    got, want = spark.read.parquet(f"{tmp_path}/out"), tumbling(events, "6 hours")
    last = want.agg(F.max("end")).first()[0]
    assert got.exceptAll(want).isEmpty()
    assert want.filter(F.col("end") < F.lit(last)).exceptAll(got).isEmpty()


def test_matching_and_tags():
    from tidemark.functions import matching as M

    assert M.one_to_one(["abc", "abd"], ["abd", "xyz"]) == [("abd", "abd", 1.0)]
    a = {"title": "t", "purpose": ["p"], "product": ["x"], "channel": ["c"], "pgm_nm": "n", "pgm_id": "1"}
    assert M.record_similarity(a, a) == pytest.approx(1.0)
    tokens = [("the", "DT", 0, 3), ("red", "JJ", 4, 7), ("ring", "NN", 8, 12)]
    assert M.drop_tags(tokens, {"DT"}, [], "the red ring") == "red ring"
    assert M.drop_tags(tokens, set(), [("JJ", "NN")], "the red ring") == "the"
    assert M.tag_spans(tokens, ("JJ", "NN"), "the red ring") == ["red ring"]
    assert M.frequent_title("zzzzzz q\naaaaaa\naaaaaaa") == "aaaaaa"


def test_one_to_one_matching_takes_all_names(spark, tmp_path):
    """Two brands of 30 and 27 names each: every pair of the plain loop, beyond the first 20 names."""
    from tidemark.plans import registry

    r = random.Random(7)
    sides = {b: sorted({"".join(r.choices("abcdef", k=r.randint(3, 9))) for _ in range(n)}) for b, n in (("A", 30), ("B", 27))}
    spark.createDataFrame([(x, "T", b) for b, names in sides.items() for x in names], "p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    pairs = sorted(((-S.ratio(x, y), i, j) for i, x in enumerate(sides["A"]) for j, y in enumerate(sides["B"])))
    want, used_a, used_b = [], set(), set()
    for s, i, j in pairs:
        if -s >= 0.5 and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            want.append((sides["A"][i], sides["B"][j], round(-s, 6)))
    got = registry.queries()["q_one_to_one_matching"](spark, str(tmp_path)).collect()
    assert sorted((x.a, x.b, x.s) for x in got) == sorted(want)
    assert max(used_a) >= 20 and max(used_b) >= 20


def test_connected_components(spark, tmp_path):
    """More than 500 nodes, keys of all residues, against union-find."""
    from tidemark.plans import registry

    r = random.Random(8)
    lines = [(r.randint(1, 2000), r.randint(1, 900)) for _ in range(700)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for o, p in lines:
        a, b = top(("order", o)), top(("part", p))
        up[a] = b
    got = {(x.kind, x.key): x.component for x in registry.queries()["q_connected_components"](spark, str(tmp_path)).collect()}
    assert set(got) == set(up) and len(got) > 500
    assert len({(top(k), c) for k, c in got.items()}) == len({top(k) for k in up}) == len(set(got.values()))


def test_component_rounds_shrink(spark, monkeypatch):
    """Edges inside a component vanish as it contracts; paths, stars, loops, double edges and null ends come out right."""
    r = random.Random(5)
    some = [(2 * r.randint(0, 999), 2 * r.randint(0, 199) + 1) for _ in range(4000)]
    path = [(10_000 + k, 10_001 + k) for k in range(120)]
    star = [(20_999, 20_000 + k) for k in range(50)]
    odd = [(30_000, 30_000), (30_001, None), (None, 30_002), (None, None), (30_004, 30_003), (30_003, 30_004)]
    written = []
    real = graph.materialize

    def counted(df, name):
        out = real(df, name)
        if name == "components-edges":
            written.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    pairs = some + path + star + odd
    rows = graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = (b if a is None else a), (a if b is None else b)
        if a is not None:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    assert len(rows) == len({x.node for x in rows}) == len(up)
    assert {x.node: x.component for x in rows} == {x: top(x) for x in up}
    assert written[-1] == 0 and sum(written) < 2 * len(pairs)


@pytest.mark.parametrize("name,rows", [("q_partition_merge", 1), ("q_month_sequence", 3)])
def test_all_orders_take_part(spark, sf_dir, name, rows):
    from tidemark.plans import registry

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = registry.queries()[name](spark, sf_dir)
    assert got.select("o_orderkey").distinct().count() == orders.count()
    assert got.count() == rows * orders.count()


def test_short_windows_join(spark, sf_dir):
    from tidemark.plans import registry

    wins = {x.win for x in registry.queries()["q_bigram_equi_join"](spark, sf_dir).select("win").distinct().collect()}
    assert any(2 <= len(w) < 6 for w in wins) and any(len(w) >= 6 for w in wins)


def test_paths_that_are_too_long_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    assert graph.paths(edges, 6).count() == 1
    with pytest.raises(RuntimeError):
        graph.paths(edges, 3)


@pytest.mark.parametrize("f,a,b,want", [
    (S.weighted, "Blue Ring", "blue ring", 1.0),
    (S.weighted, "ab", "cd", 0.0),
    (S.weighted, "abcd", "abxy", 0.3 * 0.5 + 0.1 * 0.5 + 0.2 * 0.5 + 0.2 * 0.5),
    (S.wide_ratio, "", "abc", 0.0),
    (S.wide_ratio, "red bolt", "bolt red", 0.95),
    (S.wide_ratio, "bolt", "big red bolts", 0.9),
    (S.character_similarity, "same", "same", 1.0),
    (S.character_similarity, "ab", "cd", 0.0),
    (S.best_gram_window, "bol", "a bolt", 1.0),
    (S.sequence_ratio, "abcd", "abxd", 0.75),
])
def test_further_similarities(f, a, b, want):
    assert f(a, b) == pytest.approx(want)
    assert S.longest_common_run("xabcy", "zabcw") == 3


def test_further_matching_queries(spark, sf_dir):
    """The queries without SQL, against loops over all words and names."""
    from tidemark.plans import registry

    run = lambda n: registry.queries()[n](spark, sf_dir).collect()
    import re

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    ids = {}
    for r in parts:
        ids.setdefault(r.p_name, []).append(r.p_partkey)
    words = {w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in re.findall("[a-z]+", (r.text or "").lower())}
    grams = lambda s: {x[i : i + 2] for x in [re.sub("[^a-z]", "", s.lower())] for i in range(max(1, len(x) - 1))}
    gn, gw = {n: grams(n) for n in ids}, {w: grams(w) for w in words}
    pairs = [(w, n) for w in words for n in ids if len(gn[n] & gw[w]) >= 2]
    assert {(r.word, r.p_name): r.score for r in run("q_weighted_score")} == pytest.approx({p: S.weighted(*p) for p in pairs})
    top = {}
    for w, n in pairs:
        if round(S.wide_ratio(w, n), 9) >= 0.5:
            top.setdefault(w, []).append((-round(S.wide_ratio(w, n), 9), n))
    assert {(r.word, r["rank"]): r.p_name for r in run("q_fuzzy_topk")} == {(w, i): n for w, v in top.items() for i, (_, n) in enumerate(sorted(v)[:5], 1)}
    best = {}
    for w, n in pairs:
        if round(S.fuzzy(w, n), 9) >= 0.5 and round(S.combined(w, n), 9) >= 0.3:
            best.setdefault(w, []).append((round(S.combined(w, n), 9), n))
    want = {(w, n): sorted(ids[n]) for w, v in best.items() for s, n in v if s == max(v)[0]}
    assert {(r.word, r.p_name): r.ids for r in run("q_store_match")} == want
    stops = ("the", "and", "information", "registration", "notification", "ing")
    assert {r.word for r in run("q_stop_word_like")} == {w for w in words if w not in stops and all(S.sequence_ratio(w, x) <= 0.95 for x in stops)}


def ranked_rows(n=400, seed=5):
    rng = random.Random(seed)
    # one group holds most rows, one has a null key, scores are full of ties
    return [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([0.1, 0.2, 0.5, 0.9, None]), rng.randint(0, 1)) for i in range(n)]


RANKED = "id long, g string, v double, y int"


def test_running_sums_equal_a_loop(spark):
    rows = ranked_rows()
    got = ranking.running(spark.createDataFrame(rows, RANKED), ["g"], [F.asc("id")], {"ys": "y"}).collect()
    want, seen = {}, {}
    for i, g, _, y in rows:
        seen[g] = seen.get(g, 0) + y
        want[i] = seen[g]
    assert {r.id: r.ys for r in got} == want
    got = ranking.running(spark.createDataFrame(rows, RANKED), [], [F.asc("id")], {"a": "y", "b": "id"}).collect()
    assert sorted((r.id, r.a, r.b) for r in got) == [(i, sum(x[3] for x in rows[: i + 1]), i * (i + 1) // 2) for i in range(len(rows))]
    assert ranking.running(spark.createDataFrame([], RANKED), ["g"], [F.asc("id")], {"ys": "y"}).count() == 0


def test_rank_and_quantiles_equal_a_loop(spark):
    rows = ranked_rows()
    df = spark.createDataFrame(rows, RANKED)
    key = lambda v: -1.0 if v is None else v
    want = {i: 1 + sum(1 for _, h, w, _ in rows if h == g and key(w) > key(v)) for i, g, v, _ in rows}
    assert {r.id: r["rank"] for r in ranking.with_rank(df, ["g"], "v", "rank").collect()} == want
    shares = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r.g: tuple(r[c] for c in shares) for r in ranking.quantiles(df, ["g"], "v", shares).collect()}
    for g in {r[1] for r in rows}:
        vs = sorted(v for _, h, v, _ in rows if h == g and v is not None)
        for p, q in zip(shares.values(), got[g]):
            at = (len(vs) - 1) * p
            lo = int(at)
            hi = min(lo + (at > lo), len(vs) - 1)
            assert q == pytest.approx(vs[lo] + (vs[hi] - vs[lo]) * (at - lo))
    assert ranking.quantiles(df.filter("false"), ["g"], "v", shares).count() == 0
    whole = ranking.quantiles(df.filter("v is not null"), [], "v", {"m": 0.5}).first().m
    vs = sorted(v for _, _, v, _ in rows if v is not None)
    assert whole == pytest.approx((vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2)


def test_ranking_metrics_equal_a_loop(spark):
    rows = [(i, g, v, y) for i, g, v, y in ranked_rows() if v is not None and g]
    df = spark.createDataFrame(rows, RANKED)
    order = [F.desc("v"), F.asc("id")]
    ap = {r.g: r.ap for r in ranking.average_precision(df, "g", order, "y").collect()}
    top = {r.g: (r.p, r.r) for r in ranking.top_k(df, "g", order, "y", 10).collect()}
    for g in {r[1] for r in rows}:
        ys = [y for *_, y in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))]
        hits = [sum(ys[: k + 1]) / (k + 1) for k, y in enumerate(ys) if y]
        assert ap[g] == pytest.approx(sum(hits) / len(hits))
        assert top[g] == pytest.approx((sum(ys[:10]) / len(ys[:10]), sum(ys[:10]) / sum(ys)))
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert ranking.auc(df, "v", "y").first().auc == pytest.approx(wins / len(pos) / len(neg))
    assert ranking.auc(df.filter("y = 1"), "v", "y").first().auc is None


def test_section_lines_by_priority_and_end(spark):
    texts = [
        "## DAG\n(a:b)\n### 최종 DAG\n\n```\n(x:y)\n\n (z)\n```\n(no:no)",
        "### DAG\ntext\n(a:b)\n## 3. next\n(c:d)",
        "(a:b) -[r]-> (c:d)\nplain\n# note\n(e)",
        "### DAG",
        "",
        None,
    ]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", graph.section_lines(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [["(x:y)", "(z)"], ["text", "(a:b)"], ["(a:b) -[r]-> (c:d)", "# note", "(e)"], [], [], None]


def test_is_acyclic(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "src string, dst string")
    assert graph.is_acyclic(edges(("a", "b"), ("b", "c"), ("a", "c"), ("a", "b")))
    assert not graph.is_acyclic(edges(("r", "a"), ("a", "b"), ("b", "c"), ("c", "a")))
    assert not graph.is_acyclic(edges(("a", "a")))
    assert graph.is_acyclic(spark.createDataFrame([], "src string, dst string"))


def test_loose_hits_equal_a_loop(spark):
    rng = random.Random(4)
    names = ["red bolt", "Red Bolt", "red", "blue ring set", "ring blue set", "ring", "a b c d", "a b c x", "", "set of a"]
    rows = [(rng.sample(names, rng.randint(0, 7)), rng.sample(names, rng.randint(0, 7))) for _ in range(60)]

    def alike(a, b):
        a, b = a.lower(), b.lower()
        x, y = set(a.split()), set(b.split())
        return a in b or b in a or bool(x | y) and len(x & y) / len(x | y) >= 0.7

    def hits(found, gold):
        free, n = sorted(gold), 0
        for f in sorted(found):
            m = next((g for g in free if alike(f, g)), None)
            if m is not None:
                free.remove(m)
                n += 1
        return n

    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f array<string>, g array<string>").select("i", S.loose_hits(F.col("f"), F.col("g")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [hits(*r) for r in rows]


def test_chunk_html():
    product = '<div prdid="{}"><p>name {}<br></p></div>'
    page = "<html>\n<body>" + "".join(product.format(i, "x" * i) for i in range(8)) + "</body></html>"
    assert X.chunk_html(page, 10_000) == [page] and X.chunk_html("", 5) == [""]
    chunks = X.chunk_html(page, 100)
    assert "\n".join(chunks).split("\n") == [product.format(i, "x" * i) for i in range(8)]
    assert all(len(c) <= 101 for c in chunks) and len(chunks) > 2
    by_class = page.replace("prdid", "class='A Card' id")
    assert [len(c) > 0 for c in X.chunk_html(by_class, 100)] and "Card" in X.chunk_html(by_class, 100)[0]
    plain = "<p>" + "y" * 250
    assert X.chunk_html(plain, 100) == [plain[:100], plain[100:200], plain[200:]]
    long = page.replace("name x<", "name " + "z" * 300 + "<")
    assert "".join(X.chunk_html(long, 100)).count("z") == 300
    assert X.chunk_html("</b><p>" * 100, 50)[0].startswith("</b>")


def test_the_whole_share_takes_all_rows(spark):
    from tidemark.operators import samples

    assert "ffffffff" < samples.below(1.0) and samples.below(0.5) == "80000000"
    d = spark.range(500).withColumn("k", F.lit("a"))
    assert samples.hash_sample(d, "id", 1.0, 3).count() == samples.hash_sample_by(d, "id", "k", {"a": 1.0}, 3).count() == 500


def test_nearest_rows_shuffle_no_pairs(spark, monkeypatch):
    """Several blocks, copies that tie, rows without a shared word: as by all pairs; what leaves the blocks is a few rows a query, not one a pair."""
    from tidemark.operators import nearest as N

    monkeypatch.setattr(N, "ROW_BLOCK", 60)
    monkeypatch.setattr(N, "QUERY_BLOCK", 20)
    monkeypatch.setattr(N, "PAIRS", 200)
    r = random.Random(4)
    texts = [sorted(r.sample("abcdefghijklmnop", r.randint(1, 6))) for _ in range(150)] + [["a", "b", "c"]] * 40 + [["z"], ["y"]] * 5
    rows = [(i, w, [float(r.randint(1, 3)) if i < 150 else 1.0 for _ in w]) for i, w in enumerate(texts)]
    rows = [(i, w, x, sum(v * v for v in x) ** 0.5) for i, w, x in rows]
    df = spark.createDataFrame(rows, "id long, words array<string>, x array<double>, size double")
    queries = df.filter("id % 4 = 0")
    got = N.nearest(df, queries, len(rows), queries.count(), 3).collect()
    assert len(got) <= 3 * 4 * queries.count() < len(rows) * queries.count() / 10
    for q, w, x, size in rows[::4]:
        mine = dict(zip(w, x))
        every = [(-round(sum(mine.get(a, 0.0) * b for a, b in zip(dw, dx)) / (size * ds), 9), d) for d, dw, dx, ds in rows if d != q and set(dw) & set(w)]
        assert sorted((-g.rank_sim, g.d) for g in got if g.q == q)[:3] == [(pytest.approx(s), d) for s, d in sorted(every)[:3]]


def test_tfidf_top_makes_no_row_a_pair(spark, sf_dir):
    from tidemark.plans import registry

    plan = registry.queries()["q_tfidf_topk"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_section_lines_name_the_text_once(spark):
    """The split text and the header's place are each worked out once, so the plan stays small and no pattern stands in it twice."""
    shown = spark.createDataFrame([("## DAG",)], "t string").select(graph.section_lines(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("split(") == 1
    assert all(shown.count(f"(?i){h}") == 1 for h in graph.SECTION_HEADERS)


@pytest.mark.parametrize("lines", [["2. 추출된 DAG ## dag", "## DAG", "(a:b)"], ["추출된DAG", "x", "### 2. 추출된 DAG", "(b:c)"], ["##  dag", "", "", "", "```", "(x)", "```"], ["## DAG", "", "```", "(x)"]])
def test_section_lines_of_two_headers(spark, lines):
    """The best header of any line decides, also where a line has two; an open fence ends with the text, a late one is text."""
    want = {"2. 추출된 DAG ## dag": ["## DAG", "(a:b)"], "추출된DAG": ["(b:c)"], "##  dag": ["```", "(x)", "```"], "## DAG": ["(x)"]}[lines[0]]
    got = spark.createDataFrame([("\n".join(lines),)], "t string").select(graph.section_lines(F.col("t")).alias("x")).first().x
    assert got == want
