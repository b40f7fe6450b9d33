"""Page records, the product match cascade, hashed terms and seeded samples against plain loops."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.pages import capture
from tidemark.operators import pipelines, samples
from tidemark.operators.matching import best_aliases, items_of, one_to_one_pairs
from tidemark.plans import registry
from tidemark.sources import files


def test_page_capture(spark):
    html = """<html><head><TITLE>A &amp; b</TITLE></head><body><a class=x href='/one'>One <b>1</b></a><a href="">no</a><a name="n">none</a>
    <A HREF = "/two"
    >Two</A><img alt="Pic" src='/p.png'><img src=""/><IMG src="/q.png"><p>Text</p></body></html>"""
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    got = {r.id: r.page for r in df.select("id", capture(F.col("html")).alias("page")).collect()}
    assert got[1].title == "A & b" and got[1].text.endswith("Text")
    assert [tuple(x) for x in got[1].links] == [("One 1", "/one"), ("Two", "/two")]
    assert [tuple(x) for x in got[1].images] == [("Pic", "/p.png"), ("", "/q.png")]
    assert tuple(got[2]) == ("", "", [], []) and got[3] is None


def cascade(rows, floor):
    """One entity's rows (alias, score), by the rules one after another."""
    entity, rows = rows[0], sorted(rows[1], key=lambda x: (-x[1], x[0]))
    e = entity.lower().strip()
    same = [r for r in rows if r[0].lower().strip() == e]
    inside = [r for r in rows if e in r[0].lower() or r[0].lower().strip() in e]
    if same:
        kept, tier = same[:5], "same"
    elif inside:
        ratio = lambda r: len(r[0]) / max(len(entity), 1)
        top = max(map(ratio, inside))
        long = [r for r in inside if ratio(r) >= 0.7 * top]
        kept, tier = [r for r in long if r[1] >= 0.9 * long[0][1]][:5], "contained"
    else:
        kept, tier = [r for r in rows if r[1] >= max(floor, 0.85 * rows[0][1])][:5], "similar"
    return [(entity, a, s, tier) for a, s in kept] or [(entity, a, s, "few") for a, s in rows[:3]]


def test_product_cascade_equals_plain_rules(spark):
    r = random.Random(4)
    aliases = ["ring", "Ring", " ring ", "red ring", "big red ring", "bolt", "red bolt", "x", "rod", "ringed", "bo"]
    rows = [(e, a, r.choice([0.1, 0.2, 0.35, 0.5, 0.9, 0.9])) for e in ("ring", "RED RING", "red", "bol", "widget", "gear", "") for a in aliases if r.random() < 0.7]
    rows += [("gizmo", a, 0.3) for a in ("y1", "y2", "y3", "y4")]
    got = best_aliases(spark.createDataFrame(rows, "entity string, alias string, score double"), 0.4).collect()
    want = [x for e in sorted({x[0] for x in rows}) for x in cascade((e, [(a, s) for k, a, s in rows if k == e]), 0.4)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {x[3] for x in want} >= {"same", "contained", "few"}


def test_items_of_an_alias(spark):
    matches = spark.createDataFrame([("phone 17", "phone 17", 1.0), ("phone 17", "17", 0.4), ("case", "case", 1.0)], "entity string, alias string, score double")
    items = spark.createDataFrame([("phone 17", "Phone 17", 1, "E"), ("phone 17", "Phone 17 Pro", 2, "E"), ("17", "Phone 17", 1, "E"), ("17", "Seventeen", 3, "P"), ("case", "Case A", 4, "P"), ("case", "Case B", 5, "P")], "alias string, item_nm string, item_id int, item_dmn string")
    reached = spark.createDataFrame([("phone 17", " phone 17"), ("case", "box")], "entity string, name string")
    got = sorted((r.entity, r.alias, r.item_id) for r in items_of(matches, items, reached).collect())
    assert got == [("case", "case", 4), ("case", "case", 5), ("phone 17", "phone 17", 1)]


def murmur3(data: bytes, seed: int) -> int:
    h, rot = seed, lambda x, k: (x << k | x >> (32 - k)) & 0xFFFFFFFF
    mix = lambda k: rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if len(data) > whole:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_hashing_tf_bucket_by_bucket(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        for w in (r.text or "").split(" ") if r.text is not None else []:
            key = r.item_id, murmur3(w.encode(), 42) % 1024
            want[key] = want.get(key, 0) + 1
    got = {(r.item_id, r.bucket): r.n for r in registry.queries()["q_hashing_tf_buckets"](spark, sf_dir).collect()}
    assert got == want and len({b for _, b in want}) > 50


def test_seeded_samples(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    done = df.filter("k % 3 = 0")
    first, again, other = ({r.k for r in samples.unprocessed_sample(df.repartition(p), done, "k", 50, s).collect()} for p, s in ((2, 1), (5, 1), (2, 2)))
    assert first == again != other and len(first) == 50 and all(k % 3 for k in first)
    split = samples.seeded_split(df.unionByName(df), "k", 0.25, 9)
    assert split.groupBy("k").agg(F.count_distinct("part").alias("n")).filter("n > 1").isEmpty()
    assert split.filter("part = 'train'").count() / 4000 == pytest.approx(0.25, abs=0.04)
    assert {r.f for r in df.select(samples.fold_of(F.col("k"), 4, 1).alias("f")).distinct().collect()} == {0, 1, 2, 3}


def test_pairs_equal_the_serial_greedy(spark):
    r = random.Random(5)
    rows = [(f"a{r.randint(0, 20)}", f"b{r.randint(0, 20)}", r.randint(0, 10) / 10) for _ in range(150)] + [(None, "b1", 1.0), ("a1", None, 1.0), ("a1", "b1", None)]
    got = sorted(map(tuple, one_to_one_pairs(spark.createDataFrame(rows, "x string, y string, s double"), "x", "y", "s", 0.4).collect()))
    best, used, want = {}, set(), []
    for x, y, s in rows:
        if x and y and s is not None and s >= 0.4:
            best[x, y] = max(best.get((x, y), 0), s)
    for (x, y), s in sorted(best.items(), key=lambda k: (-k[1], k[0])):
        if not {("x", x), ("y", y)} & used:
            used |= {("x", x), ("y", y)}
            want.append((x, y, s))
    assert got == sorted(want) and len(want) > 10
    assert one_to_one_pairs(spark.createDataFrame([], "x string, y string, s double"), "x", "y", "s").count() == 0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0)], "id int, name string, price double")
    files.export_json(df, f"file://{tmp_path}/j", base={"kind": F.lit("x")})
    lines = sorted(x for f in tmp_path.glob("j/part-*") for x in f.read_text().splitlines())
    assert lines == ['{"id":1,"name":"a","kind":"x"}', '{"id":2,"name":null,"kind":"x"}']
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 9), (4, 9)], "id int, at int")
    assert [x.id for x in files.latest(rows, "at", 3, tie="id").collect()] == [4, 3, 1]
    assert [x.id for x in files.latest(rows, "at", 3, F.col("id") < 3).collect()] == [1, 2]


def test_sampled_pipelines_score_all_rows(spark, sf_dir):
    rows = registry.queries()["q_sampled_pipelines"](spark, sf_dir).collect()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert {(r.user_id, r.send_hour) for r in rows} == {(r.user_id, r.h) for r in events.select("user_id", F.hour("ts").alias("h")).distinct().collect()}
    assert all(0 <= r.prob_click <= 1 and 0 <= r.prob_gap <= 1 and r.propensity_score == pytest.approx(r.prob_click * r.prob_gap, abs=1e-3) for r in rows)


def test_columns_are_normalized(spark):
    df = spark.createDataFrame([(1, 2)], "`A ` int, Bc int")
    assert files.normalized(df, {"d": F.lit(3), "a": F.lit(9)}).first().asDict() == {"a": 1, "bc": 2, "d": 3}
    with pytest.raises(ValueError, match="case"):
        files.normalized(spark.createDataFrame([(1, 2)], "a int, ` A` int"))


def test_results_paths_and_models(spark, tmp_path):
    assert files.versioned_path("/data/", "model", "202401", "202403") == "/data/model_202401_202403"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    for _ in range(2):  # the file is made, then appended to
        files.append_results(df, f"file://{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r").count() == 4
    data = spark.createDataFrame([(float(i % 5), ["u", "v"][i % 2], i % 2) for i in range(40)], "x_amt float, k_cd string, y int")
    model = pipelines.feature_pipeline(data.select("x_amt", "k_cd"), scale=False).fit(data)
    path = f"file://{tmp_path}/model"
    pipelines.save_model(model, path)
    pipelines.save_model(model, path)  # overwrites
    want = [r.features for r in model.transform(data).select("features").collect()]
    assert [r.features for r in pipelines.load_model(path).transform(data).select("features").collect()] == want


def test_consensus_sums_in_the_order_of_names(spark, tmp_path):
    """A mean of exactly 0.4, which rounds up for one user and down for the other, and the other way in another order."""
    kinds = {"c": "click", "p": "purchase", "v": "view"}
    shared = {1: ["cpv", *["pv"] * 4, "v"], 2: ["cpv", *["pv"] * 4, *["c"] * 5]}
    rows = [(u, kinds[k], datetime(2024, 1, d, h)) for u, hours in shared.items() for h, ks in enumerate(hours) for k in ks for d in range(1, 6)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in registry.queries()["q_consensus_truth"](spark, str(tmp_path)).collect()] == [(1, 0.4, "C")]


@pytest.mark.parametrize("first,last,months", [("2023-01-31", "2023-02-28", 1), ("2023-01-29", "2023-02-28", 1), ("2023-01-30", "2023-02-27", 0), ("2024-01-30", "2024-02-28", 0), ("2023-02-28", "2023-03-30", 1), ("2022-12-15", "2023-03-14", 2)])
def test_last_day_completes_a_month(spark, tmp_path, first, last, months):
    rows = [(1, datetime.fromisoformat(x)) for x in (first, last)]
    spark.createDataFrame(rows, "client_id long, sold_at timestamp").write.parquet(f"{tmp_path}/sales.parquet")
    assert [tuple(r) for r in registry.queries()["q_months_between"](spark, str(tmp_path)).collect()] == [(1, months)]
