"""Joins, filters, aggregations, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import dict_filter, generic_agg, keep_first, merge_frames
from tidemark.operators import ranking as R
from tidemark.plans.registry import Tables, query


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 OR o_totalprice IS NULL")
def q_filter_null_or_between(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.filter(p.isNull() | p.between(1000, 50000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_dict_filter_and(t: Tables) -> DataFrame:
    return dict_filter(t.orders, {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority IN ('5-LOW')")
def q_dict_filter_or(t: Tables) -> DataFrame:
    return dict_filter(t.orders, {"o_orderstatus": "P", "o_orderpriority": ("5-LOW",)}, "OR").select("o_orderkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def q_dedup_keep_first(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return keep_first(rows, ["l_orderkey"], F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(round(v, 2), 0.0) AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def q_left_join_fill(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna({"n_orders": 0, "spent": 0.0})


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def q_broadcast_join(t: Tables) -> DataFrame:
    # nation and region are fixed dimensions; without the hint Spark still broadcasts below its own threshold
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey, CASE WHEN o_custkey IS NOT NULL THEN 'Y' ELSE 'N' END AS urgent_yn FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey")
def q_join_exists_flag(t: Tables) -> DataFrame:
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return t.customer.select("c_custkey").join(urgent, "c_custkey", "left").select("c_custkey", F.when(F.col("hit").isNotNull(), "Y").otherwise("N").alias("urgent_yn"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q_semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def q_anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND event_type = 'view'")
def q_unprocessed_anti(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return t.events.filter("event_type = 'view'").select("event_id").join(done, "event_id", "left_anti")


@query("""SELECT coalesce(a.k, b.k, d.k) AS k, n_cust, n_supp, n_nation FROM (SELECT c_nationkey AS k, count(*) AS n_cust FROM customer WHERE c_nationkey < 20 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_supp FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT n_nationkey AS k, count(*) AS n_nation FROM nation GROUP BY 1) d ON coalesce(a.k, b.k) = d.k""")
def q_full_outer_merge(t: Tables) -> DataFrame:
    a = t.customer.filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_cust"))
    b = t.supplier.filter("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_supp"))
    d = t.nation.groupBy(F.col("n_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_nation"))
    return merge_frames([a, b, d], ["k"])


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem GROUP BY ALL")
def q_basic_aggs(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def q_collect_set(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.concat_ws(",", F.array_sort(F.collect_set("o_orderpriority"))).alias("priorities"))


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum, max(o_totalprice) AS o_totalprice_max, count(DISTINCT o_custkey) AS o_custkey_nunique FROM orders GROUP BY 1")
def q_generic_agg(t: Tables) -> DataFrame:
    out = generic_agg(t.orders, ["o_orderstatus"], {"o_totalprice": ["sum", "max"], "o_custkey": "nunique"})
    return out.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))


@query("SELECT p_name, p_type, min(p_partkey) AS first_key FROM part GROUP BY ALL")
def q_message_dedup(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("first_key"))


@query("SELECT p_type, count(*) AS n, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1")
def q_value_counts(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("n_names"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def q_summary_stats(t: Tables) -> DataFrame:
    v = "value"
    return t.events.groupBy("event_type").agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def q_quantiles(t: Tables) -> DataFrame:
    got = R.quantiles(t.events, ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return got.select("event_type", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def q_topn_per_user(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT o_custkey, best, CAST((row_number() OVER (ORDER BY best DESC, o_custkey) - 1) // 100 AS BIGINT) AS batch_id FROM (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1)")
def q_priority_batches(t: Tables) -> DataFrame:
    from tidemark.operators.allocation import global_rank

    best = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    return global_rank(best, [F.desc("best"), F.asc("o_custkey")], "r").select("o_custkey", "best", F.expr("(r - 1) div 100").alias("batch_id"))


@query("SELECT event_type, event_id, CAST(rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS INTEGER) AS rank FROM events")
def q_rank_prob(t: Tables) -> DataFrame:
    got = R.with_rank(t.events.select("event_type", "event_id", "value"), ["event_type"], "value", "rank")
    return got.select("event_type", "event_id", F.col("rank").cast("int").alias("rank"))


@query("SELECT p_name, p_brand, n, CAST(r AS INTEGER) AS rank FROM (SELECT p_name, p_brand, count(*) AS n, dense_rank() OVER (PARTITION BY p_name ORDER BY count(*) DESC) AS r FROM part GROUP BY 1, 2) WHERE r <= 2")
def q_dense_rank_limit(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.dense_rank().over(Window.partitionBy("p_name").orderBy(F.desc("n")))).filter("rank <= 2").select("p_name", "p_brand", "n", "rank")


@query("SELECT p_type, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5")
def q_rank_min_topn(t: Tables) -> DataFrame:
    return t.part.withColumn("r", F.rank().over(Window.partitionBy("p_type").orderBy(F.desc("p_size")))).filter("r <= 5").select("p_type", "p_partkey", "p_size")


@query("SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def q_best_per_entity(t: Tables) -> DataFrame:
    return keep_first(t.part.select("p_name", "p_partkey", "p_retailprice"), ["p_name"], F.desc("p_retailprice"), F.asc("p_partkey"))


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def q_topk(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(100)


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def q_union_all(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def q_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""WITH a AS (SELECT user_id, list_distinct(list(event_type)) AS s FROM events WHERE day(ts) <= 15 GROUP BY 1), b AS (SELECT user_id, list_distinct(list(event_type)) AS s FROM events WHERE day(ts) > 15 GROUP BY 1)
SELECT user_id, CAST(len(list_intersect(a.s, b.s)) AS INTEGER) AS n_both, CAST(len(list_distinct(list_concat(a.s, b.s))) AS INTEGER) AS n_any, list_contains(a.s, 'click') AS clicked FROM a JOIN b USING (user_id)""")
def q_array_set_ops(t: Tables) -> DataFrame:
    half = lambda c, n: t.events.filter(c).groupBy("user_id").agg(F.collect_set("event_type").alias(n))
    both = half("day(ts) <= 15", "a").join(half("day(ts) > 15", "b"), "user_id")
    return both.select("user_id", F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_union("a", "b")).alias("n_any"), F.array_contains("a", "click").alias("clicked"))


@query("SELECT p_partkey, a, b FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS a, p_type || '&&' || p_brand AS s FROM part), unnest(string_split(s, '&&')) u(b)")
def q_split_explode(t: Tables) -> DataFrame:
    first = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("a"), F.split(F.concat_ws("&&", "p_type", "p_brand"), "&&").alias("s"))
    return first.select("p_partkey", "a", F.explode("s").alias("b"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS sha16 FROM customer")
def q_sha16(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.substring(F.sha2("c_name", 256), 1, 16).alias("sha16"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders), x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey FROM x, n WHERE i % (n // 20) = 0 AND i // (n // 20) < 20""")
def q_even_anchors(t: Tables) -> DataFrame:
    """Twenty rows at even distances; all rows if there are no more than twenty."""
    from tidemark.operators.allocation import global_rank

    ranked = global_rank(t.orders.select("o_orderkey"), [F.asc("o_orderkey")], "r")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    step = F.expr("greatest(n div 20, 1)")
    i = F.col("r") - 1
    return ranked.crossJoin(F.broadcast(n)).filter((F.col("n") <= 20) | ((i % step == 0) & (i / step < 20))).select("o_orderkey")
