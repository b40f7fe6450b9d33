"""Result building, ontology graphs, structured comparison, samples and further filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import matching as M
from tidemark.operators import graph as G
from tidemark.operators import allocation as A
from tidemark.operators import optimal
from tidemark.plans.allocation import capacity, scores
from tidemark.plans.registry import Tables, query


@query("SELECT conv_id, turn, role, substr(trim(text), 1, 10000) AS message FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''")
def q_valid_messages(t: Tables) -> DataFrame:
    """Messages without outer blanks, long ones cut as the message contract says; blank ones go."""
    m = F.trim("text")
    return t.conversations.filter(m != "").select("conv_id", "turn", "role", F.substring(m, 1, 10000).alias("message"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT IN ('small ring', 'red bolt') AND NOT contains(lower(p_name), 'gear')")
def q_stop_words(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.filter(~F.coalesce(n.isin("small ring", "red bolt"), F.lit(False)) & ~F.coalesce(F.contains(F.lower(n), F.lit("gear")), F.lit(False))).select("p_partkey", "p_name")


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'offer' WHEN 'SMALL' THEN 'item' WHEN 'LARGE' THEN 'device' ELSE 'other' END AS domain_nm FROM part")
def q_domain_names(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in (("PROMO", "offer"), ("SMALL", "item"), ("LARGE", "device")) for x in kv])
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(names, "p_type"), F.lit("other")).alias("domain_nm"))


@query("SELECT p.p_partkey, coalesce(CAST(max(l_orderkey) AS VARCHAR), '#') AS item_id, CASE WHEN max(l_orderkey) IS NULL THEN 'other' ELSE 'buy' END AS action FROM part p LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) l ON l_partkey = p_partkey GROUP BY 1")
def q_no_match_fallback(t: Tables) -> DataFrame:
    best = t.lineitem.filter("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_orderkey").alias("k"))
    j = t.part.select("p_partkey").join(best, "p_partkey", "left")
    return j.select("p_partkey", F.coalesce(F.col("k").cast("string"), F.lit("#")).alias("item_id"), F.when(F.col("k").isNull(), "other").otherwise("buy").alias("action"))


@query("SELECT p_partkey, p_name, 'main' AS role FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size > 45) UNION ALL SELECT p_partkey, p_name, 'offer' FROM part WHERE p_type = 'PROMO'")
def q_role_filter(t: Tables) -> DataFrame:
    dropped = t.part.filter("p_type = 'ECONOMY' and p_size > 45").select("p_brand").distinct()
    main = t.part.join(dropped, "p_brand", "left_anti").select("p_partkey", "p_name", F.lit("main").alias("role"))
    return main.unionByName(t.part.filter("p_type = 'PROMO'").select("p_partkey", "p_name", F.lit("offer").alias("role")))


@query("SELECT n_nationkey, n_name FROM nation WHERE trim(regexp_replace(n_name, '_', ' ', 'g')) IN ('NATION 1', 'NATION 7', 'NATION 11')")
def q_program_mapping(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("NATION 1",), ("NATION 7",), ("NATION 11",)], "clean string")
    return t.nation.withColumn("clean", F.trim(F.regexp_replace("n_name", "_", " "))).join(wanted, "clean", "left_semi").select("n_nationkey", "n_name")


@query("SELECT p_partkey, p_name || ' v1' AS body FROM part")
def q_code_block(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("note\n```json\n"), "p_name", F.lit(" v1\n```\nend"))
    return t.part.select("p_partkey", F.trim(F.regexp_extract(fenced, "(?s)```[a-z]*\\n(.*?)```", 1)).alias("body")).withColumn("body", F.regexp_replace("body", "\\n$", ""))


@query("SELECT n_name || ':' || CASE WHEN n_nationkey % 3 = 0 THEN 'Unknown' ELSE 'Place' END AS src, 'IN' AS rel, r_name || ':Region' AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_ontology_edges(t: Tables) -> DataFrame:
    types = t.nation.filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("entity"), F.lit("Place").alias("type")).unionByName(t.region.select(F.col("r_name").alias("entity"), F.lit("Region").alias("type")))
    rel = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    a, b = types.toDF("source", "st"), types.toDF("target", "tt")
    node = lambda n, k: F.concat_ws(":", n, F.coalesce(k, F.lit("Unknown")))
    return rel.join(a, "source", "left").join(b, "target", "left").select(node("source", "st").alias("src"), F.lit("IN").alias("rel"), node("target", "tt").alias("dst"))


def _spread(part: DataFrame) -> DataFrame:
    """The parts over all cores: their file is small, and would be few tasks, for the work that each row makes."""
    return part.select("p_partkey", "p_name", "p_brand").repartition(part.sparkSession.sparkContext.defaultParallelism)


@query("SELECT p_partkey, '(' || p_name || ':has)' AS line FROM part")
def q_dag_section(t: Tables) -> DataFrame:
    """The lines of an answer's graph section."""
    answer = F.concat(F.lit("intro\n### DAG\n\n("), "p_name", F.lit(":has)\n"))
    return _spread(t.part).select("p_partkey", F.explode(G.section_lines(answer)).alias("line"))


@query("""SELECT p_partkey, CAST(k AS INTEGER) AS line_no, CASE k WHEN 0 THEN '(' || p_name || ':has) -[IS]-> (' || p_brand || ':of)' ELSE '(' || p_brand || ':alone)' END AS line FROM part, range(0, 2) r(k)""")
def q_dag_headers(t: Tables) -> DataFrame:
    """Every header form, fenced and bare, with other sections around it; the lines keep their order."""
    heads = ("### 최종 DAG", "## 4. 수정된 DAG", "### 수정된  DAG", "### 2. 추출된 DAG", "## dag", "추출된 DAG:", "2. 추출된DAG", "no header")
    head = F.get(F.array(*map(F.lit, heads)), (F.col("p_partkey") % len(heads)).cast("int"))
    fence = F.when(F.col("p_partkey") % 3 == 0, "\n```\n").otherwise("\n")
    edge = F.concat(F.lit("("), "p_name", F.lit(":has) -[IS]-> ("), "p_brand", F.lit(":of)\n\n ("), "p_brand", F.lit(":alone)"))
    after = F.when(F.contains(head, F.lit("no header")), "\nend").otherwise("\n### 3. (a:b)\n(c:d)")
    answer = F.concat(F.lit("thought\n"), head, fence, edge, fence, after)
    return _spread(t.part).select("p_partkey", F.posexplode(G.section_lines(answer)).alias("line_no", "line"))


_PAIRS = "(SELECT user_id AS k, event_type AS e, CAST(hour(ts) AS INTEGER) AS a FROM events WHERE day(ts) {} 15 GROUP BY ALL)"


@query(f"""WITH g AS {_PAIRS.format("<=")}, p AS {_PAIRS.format(">")}, h AS (SELECT k, count(*) AS hit FROM g JOIN p USING (k, e, a) GROUP BY 1)
SELECT k, round(2.0 * coalesce(hit, 0) / (ng + np), 6)::DOUBLE AS f1 FROM (SELECT k, count(*) AS ng FROM g GROUP BY 1) JOIN (SELECT k, count(*) AS np FROM p GROUP BY 1) USING (k) LEFT JOIN h USING (k)""")
def q_exact_f1(t: Tables) -> DataFrame:
    half = lambda c: t.events.filter(c).select(F.col("user_id").alias("k"), F.col("event_type").alias("e"), F.hour("ts").alias("a")).distinct()
    g, p = half("day(ts) <= 15"), half("day(ts) > 15")
    n = lambda d, c: d.groupBy("k").agg(F.count(F.lit(1)).alias(c))
    x = n(g, "ng").join(n(p, "np"), "k").join(n(g.join(p, ["k", "e", "a"]), "hit"), "k", "left").fillna(0, ["hit"])
    return x.select("k", F.round(2 * F.col("hit") / (F.col("ng") + F.col("np")), 6).alias("f1"))


@query("SELECT CAST(u.id AS VARCHAR) AS \"user\", CAST(h AS INTEGER) AS \"hour\", round(least(0.99, greatest(0.1, 0.9 - 0.08 * abs(h - (9 + (u.id * 7) % 10)) + ((u.id * 31 + h * 17) % 11) / 100.0)), 6)::DOUBLE AS score FROM range(0, 200) u(id), range(9, 19) r(h)")
def q_synthetic_scores(t: Tables) -> DataFrame:
    """A grid of users and hours; the score falls with the distance from the user's own hour."""
    grid = t.spark.range(200).select("id", F.explode(F.sequence(F.lit(9), F.lit(18))).alias("hour"))
    raw = 0.9 - 0.08 * F.abs(F.col("hour") - (9 + F.col("id") * 7 % 10)) + (F.col("id") * 31 + F.col("hour") * 17) % 11 / 100
    return grid.select(F.col("id").cast("string").alias("user"), "hour", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.1), raw)), 6).alias("score"))


@query("SELECT o_orderkey, CAST(ntile AS INTEGER) AS fold FROM (SELECT o_orderkey, o_orderkey % 5 AS ntile FROM orders)")
def q_hash_split(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("fold"))


@query()
def q_optimal_allocation(t: Tables) -> DataFrame:
    s = scores(t)
    return optimal.optimal_allocation(s, capacity(s), everyone=False).assigned


@query()
def q_allocation_bound(t: Tables) -> DataFrame:
    """Users and total of the optimum and of greedy, with the gap to the bound that the optimum's prices prove."""
    s = scores(t)
    best = optimal.optimal_allocation(s, capacity(s), everyone=False)
    summed = lambda d, how, gap: d.agg(F.count(F.lit(1)).alias("users"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6).alias("total")).select(F.lit(how).alias("how"), "users", "total", gap.alias("gap"))
    return summed(best.assigned, "optimum", F.lit(round(best.gap, 6))).unionByName(summed(A.greedy_allocation(s, capacity(s)), "greedy", F.lit(None).cast("double")))


@query()
def q_hybrid_allocation(t: Tables) -> DataFrame:
    s = scores(t)
    return optimal.hybrid_allocation(s, capacity(s), choices=2)


@query()
def q_one_to_one_matching(t: Tables) -> DataFrame:
    """All names of two brands, paired greedily by similarity."""
    n = t.part.groupBy("p_type", "p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    order = Window.partitionBy("p_type").orderBy("p_brand")
    both = n.withColumn("next", F.lead("names").over(order)).filter("next is not null")
    return both.select("p_type", "p_brand", F.inline(M.one_to_one_udf("names", "next")))


@query()
def q_record_similarity(t: Tables) -> DataFrame:
    """Records of neighbouring parts against one another."""
    record = F.struct(F.col("p_name").alias("title"), F.split("p_name", " ").alias("purpose"), F.array("p_name", "p_brand").alias("product"), F.array("p_type").alias("channel"), F.col("p_brand").alias("pgm_nm"), F.col("p_size").cast("string").alias("pgm_id"))
    a = t.part.select("p_partkey", F.to_json(record).alias("a"))
    b = a.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b"))

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        import json

        return pd.Series([round(M.record_similarity(json.loads(p), json.loads(q)), 6) for p, q in zip(x, y)])

    return a.join(b, "p_partkey").select("p_partkey", score("a", "b").alias("similarity"))


@query()
def q_frequent_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", M.frequent_title_udf("text").alias("title"))
