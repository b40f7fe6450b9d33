"""Queries that turn contact events into response facts and features.

events stands for the contact and usage log: view is a send, click a click,
purchase a read; value is traffic; user_id the customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import lookback_counts, role_projection, undersample_ratios
from tidemark.plans.registry import Tables, query

HOURS = list(range(9, 19))
_FOLD = """
SELECT user_id, CAST(ts AS DATE) AS send_dt,
  sum(CASE WHEN event_type='view' THEN 1 ELSE 0 END) AS send_cnt,
  sum(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS click_cnt,
  min(CASE WHEN event_type='view' THEN ts END) AS send_ts,
  min(CASE WHEN event_type='click' THEN ts END) AS click_ts,
  sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS read_cnt
FROM events GROUP BY ALL"""


def fold(events: DataFrame) -> DataFrame:
    """One row per user and day: counts and first times of sends, clicks and reads."""
    is_ = lambda k: F.col("event_type") == k
    return events.groupBy("user_id", F.to_date("ts").alias("send_dt")).agg(
        F.count(F.when(is_("view"), 1)).alias("send_cnt"),
        F.count(F.when(is_("click"), 1)).alias("click_cnt"),
        F.min(F.when(is_("view"), F.col("ts"))).alias("send_ts"),
        F.min(F.when(is_("click"), F.col("ts"))).alias("click_ts"),
        F.count(F.when(is_("purchase"), 1)).alias("read_cnt"),
    )


def seconds(a: str, b: str):
    """Whole seconds from a to b."""
    return F.expr(f"timestampdiff(SECOND, {a}, {b})")


@query(f"""SELECT user_id, send_dt, CAST(send_cnt AS BIGINT) AS send_cnt, CAST(click_cnt AS BIGINT) AS click_cnt, send_ts, click_ts,
  CASE WHEN click_ts IS NULL THEN 0 ELSE 1 END AS click_yn,
  CAST(trunc(date_diff('microsecond', send_ts, click_ts) / 3600000000.0) AS BIGINT) AS hour_gap
FROM ({_FOLD}) WHERE send_cnt >= 1 AND read_cnt <= 1 AND (click_ts IS NULL OR click_ts >= send_ts)""")
def q_response_fold(t: Tables) -> DataFrame:
    facts = fold(t.events).filter("send_cnt >= 1 and read_cnt <= 1 and (click_ts is null or click_ts >= send_ts)")
    return facts.select("user_id", "send_dt", "send_cnt", "click_cnt", "send_ts", "click_ts", F.when(F.col("click_ts").isNull(), 0).otherwise(1).alias("click_yn"), F.expr("timestampdiff(HOUR, send_ts, click_ts)").alias("hour_gap"))


@query(f"""SELECT user_id, send_dt, CASE WHEN click_ts IS NULL OR click_ts < send_ts THEN 0.0 ELSE
  round(1.0 / (1 + trunc(date_diff('microsecond', send_ts, click_ts) / 3600000000.0)), 6) END::DOUBLE AS res_utility FROM ({_FOLD}) WHERE send_cnt >= 1""")
def q_res_utility(t: Tables) -> DataFrame:
    gap = F.expr("timestampdiff(HOUR, send_ts, click_ts)")
    worth = F.when(F.col("click_ts").isNull() | (F.col("click_ts") < F.col("send_ts")), 0.0).otherwise(F.round(1 / (1 + gap), 6))
    return fold(t.events).filter("send_cnt >= 1").select("user_id", "send_dt", worth.alias("res_utility"))


@query(f"""SELECT user_id, send_dt, CAST(date_diff('day', CAST(send_ts AS DATE), CAST(click_ts AS DATE)) AS INTEGER) AS day_gap,
  CAST(trunc(date_diff('microsecond', send_ts, click_ts)/3600000000.0) AS BIGINT) AS hour_gap,
  CAST(trunc(date_diff('microsecond', send_ts, click_ts)/60000000.0) AS BIGINT) AS minute_gap,
  CAST(trunc(date_diff('microsecond', send_ts, click_ts)/1000000.0) AS BIGINT) AS second_gap
FROM ({_FOLD}) WHERE send_ts IS NOT NULL AND click_ts IS NOT NULL""")
def q_time_gaps(t: Tables) -> DataFrame:
    gaps = {f"{u}_gap": F.expr(f"timestampdiff({u.upper()}, send_ts, click_ts)") for u in ("hour", "minute", "second")}
    f = fold(t.events).filter("send_ts is not null and click_ts is not null")
    return f.select("user_id", "send_dt", F.datediff(F.to_date("click_ts"), F.to_date("send_ts")).alias("day_gap"), *[c.alias(n) for n, c in gaps.items()])


@query("""SELECT event_id, CAST(dayofweek(ts) + 1 AS INTEGER) AS daynum, CAST(hour(ts) AS INTEGER) AS hournum, strftime(ts, '%Y%m') AS ym, strftime(ts, '%Y%m%d') AS dt FROM events""")
def q_calendar_parts(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.dayofweek("ts").alias("daynum"), F.hour("ts").alias("hournum"), F.date_format("ts", "yyyyMM").alias("ym"), F.date_format("ts", "yyyyMMdd").alias("dt"))


@query("""SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH, '%Y%m') AS feature_ym, strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 DAY, '%Y%m') AS prev_day_ym FROM orders""")
def q_feature_month(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(F.add_months(day, -1), "yyyyMM").alias("feature_ym"), F.date_format(F.date_sub(day, 1), "yyyyMM").alias("prev_day_ym"))


def months_back(orders: DataFrame) -> DataFrame:
    """The month of each order and the two before."""
    start = F.trunc("o_orderdate", "month")
    months = F.sequence(F.add_months(start, -2), start, F.expr("interval 1 month"))
    return orders.select("o_orderkey", F.explode(months).alias("m")).select("o_orderkey", F.date_format("m", "yyyyMM").alias("ym"))


@query("""SELECT o_orderkey, strftime(CAST(date_trunc('month', o_orderdate) AS DATE) - to_months(CAST(k AS INTEGER)), '%Y%m') AS ym FROM orders, range(0, 3) r(k)""")
def q_month_sequence(t: Tables) -> DataFrame:
    return months_back(t.orders)


@query("""SELECT event_id, CASE WHEN event_type IN ('view','click') THEN 'MMS' WHEN event_type='purchase' THEN 'RCS' ELSE 'UKV' END AS chnl_typ,
  CASE WHEN event_type='signup' THEN 'Y' ELSE 'N' END AS url_yn FROM events""")
def q_case_mapping(t: Tables) -> DataFrame:
    k = F.col("event_type")
    return t.events.select("event_id", F.when(k.isin("view", "click"), "MMS").when(k == "purchase", "RCS").otherwise("UKV").alias("chnl_typ"), F.when(k == "signup", "Y").otherwise("N").alias("url_yn"))


_WIDE = "SELECT user_id, " + ", ".join(f"coalesce(sum(CASE WHEN hour(ts)={h} THEN value END), 0) AS t{h:02d}" for h in HOURS) + " FROM events GROUP BY user_id"


def usage_wide(events: DataFrame) -> DataFrame:
    """Traffic per user, one column an hour from 9 to 18."""
    return events.groupBy("user_id").agg(*[F.coalesce(F.sum(F.when(F.hour("ts") == h, F.col("value"))), F.lit(0.0)).alias(f"t{h:02d}") for h in HOURS])


@query("SELECT user_id, CAST(h AS INTEGER) AS hournum, round(v, 4) AS traffic FROM (" + " UNION ALL ".join(f"SELECT user_id, {h} AS h, t{h:02d} AS v FROM w" for h in HOURS).join(["WITH w AS (" + _WIDE + ") SELECT * FROM (", ")"]) + ") WHERE v > 100")
def q_unpivot_hours(t: Tables) -> DataFrame:
    stacked = usage_wide(t.events).unpivot("user_id", [f"t{h:02d}" for h in HOURS], "col", "v")
    return stacked.filter("v > 100").select("user_id", F.substring("col", 2, 2).cast("int").alias("hournum"), F.round("v", 4).alias("traffic"))


@query("SELECT user_id, " + ", ".join(f"coalesce(max(CASE WHEN h={h} THEN s END), '#') AS token_{h:02d}" for h in HOURS) + " FROM (SELECT user_id, hour(ts) AS h, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS s FROM events GROUP BY ALL) GROUP BY user_id")
def q_pivot_hours(t: Tables) -> DataFrame:
    tokens = t.events.groupBy("user_id", F.hour("ts").alias("h")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("event_type"))).alias("s"))
    wide = tokens.groupBy("user_id").pivot("h", HOURS).agg(F.first("s"))
    return wide.select("user_id", *[F.coalesce(F.col(str(h)), F.lit("#")).alias(f"token_{h:02d}") for h in HOURS])


@query("""SELECT user_id, h AS peak_hour, c AS peak_cnt FROM (SELECT user_id, CAST(hour(ts) AS INTEGER) AS h, count(*) AS c,
  row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, hour(ts) DESC) AS r FROM events GROUP BY user_id, hour(ts)) WHERE r = 1""")
def q_argmax_struct(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("user_id").agg(F.max(F.struct("c", "h")).alias("p")).select("user_id", F.col("p.h").alias("peak_hour"), F.col("p.c").alias("peak_cnt"))


@query("""SELECT user_id, count(CASE WHEN value > 100 THEN 1 END) AS heavy_cnt, count(CASE WHEN value BETWEEN 10 AND 100 THEN 1 END) AS medium_cnt, count(CASE WHEN value < 10 THEN 1 END) AS light_cnt FROM events GROUP BY user_id""")
def q_banded_counts(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy("user_id").agg(F.count(F.when(v > 100, 1)).alias("heavy_cnt"), F.count(F.when(v.between(10, 100), 1)).alias("medium_cnt"), F.count(F.when(v < 10, 1)).alias("light_cnt"))


_MONTHLY = "SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY ALL"


def monthly_orders(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH a AS ({_MONTHLY}) SELECT a.o_custkey, a.m, a.n, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS prev3 FROM a LEFT JOIN a b
  ON a.o_custkey = b.o_custkey AND b.m < a.m AND b.m >= a.m - INTERVAL 3 MONTH GROUP BY ALL""")
def q_lookback_explode(t: Tables) -> DataFrame:
    got = lookback_counts(t.orders, ["o_custkey"], F.trunc("o_orderdate", "month"), 3, "n", "prev3")
    return got.withColumnRenamed("period", "m")


@query(f"""WITH a AS ({_MONTHLY}) SELECT a.o_custkey, a.m, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS prev2 FROM a LEFT JOIN a b
  ON a.o_custkey = b.o_custkey AND b.m < a.m AND b.m >= a.m - INTERVAL 2 MONTH GROUP BY ALL""")
def q_lookback_self_join(t: Tables) -> DataFrame:
    """The range form; months are bounded to 2, so each row meets at most two others."""
    a = monthly_orders(t.orders)
    b = a.select("o_custkey", F.explode(F.array(F.add_months("m", 1), F.add_months("m", 2))).alias("m"), F.col("n").alias("k"))
    return a.join(b, ["o_custkey", "m"], "left").groupBy("o_custkey", "m").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("prev2"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IS NULL OR c_mktsegment='' THEN 'UKV' ELSE c_mktsegment END AS c_segment_cd,
  CAST(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS FLOAT) IS NULL AS missing, round(coalesce(CAST(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS FLOAT), 0)::DOUBLE, 2) AS acctbal FROM customer""")
def q_role_projection(t: Tables) -> DataFrame:
    raw = t.customer.select("c_custkey", F.col("c_mktsegment").alias("c_segment_cd"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal_amt"))
    p = role_projection(raw)
    return p.select("c_custkey", "c_segment_cd", F.isnan("c_acctbal_amt").alias("missing"), F.round(F.nanvl("c_acctbal_amt", F.lit(0.0)).cast("double"), 2).alias("acctbal"))


@query("""SELECT r_name, n_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_cust, round(sum(o_totalprice), 2) AS revenue FROM orders
  JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ALL""")
def q_star_join(t: Tables) -> DataFrame:
    # totals per customer first: the shuffle carries customers, not orders
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    star = per.join(t.customer, "c_custkey").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return star.groupBy("r_name", "n_name").agg(F.sum("n").alias("n_orders"), F.count(F.lit(1)).alias("n_cust"), F.round(F.sum("v"), 2).alias("revenue"))


@query("""WITH c AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS h, CASE WHEN value > 100 THEN 1 ELSE 0 END AS label, count(*) AS cnt FROM events GROUP BY ALL)
SELECT event_type, h, label, cnt, min(cnt) OVER (PARTITION BY event_type, h) AS min_cnt, round(least(1.0::DOUBLE, 3.0 * min(cnt) OVER (PARTITION BY event_type, h) / cnt), 6)::DOUBLE AS ratio FROM c""")
def q_undersample_ratio(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.hour("ts").alias("h"), F.when(F.col("value") > 100, 1).otherwise(0).alias("label"))
    return undersample_ratios(rows, ["event_type", "h"], "label", 3.0).withColumn("ratio", F.round("ratio", 6))


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test' END AS part FROM orders WHERE o_orderdate < TIMESTAMP '1999-07-01'""")
def q_temporal_split(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.filter(d < F.lit("1999-07-01").cast("timestamp_ntz")).select("o_orderkey", F.when(d < F.lit("1999-01-01").cast("timestamp_ntz"), "train").otherwise("test").alias("part"))


@query("""SELECT user_id, CAST(h AS INTEGER) AS send_hour FROM (SELECT DISTINCT user_id FROM events), range(9, 19) r(h)""")
def q_hour_grid(t: Tables) -> DataFrame:
    return t.events.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(9), F.lit(18))).alias("send_hour"))


@query("""SELECT CAST(hour(ts) AS INTEGER) AS h, round(avg(n), 6) AS avg_per_user, count(*) AS n_users FROM (SELECT ts, user_id, count(*) OVER (PARTITION BY user_id, hour(ts)) AS n,
  row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY event_id) AS r FROM events) WHERE r = 1 GROUP BY hour(ts)""")
def q_two_level_avg(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("h").agg(F.round(F.avg("n"), 6).alias("avg_per_user"), F.count(F.lit(1)).alias("n_users"))


@query("""SELECT date_trunc('day', max(ts)) AS last_day, count(*) AS total, count(CASE WHEN event_type <> 'error' THEN 1 END) AS ok,
  count(CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR THEN 1 END) AS recent,
  round(count(CASE WHEN event_type <> 'error' THEN 1 END) * 100.0 / count(*), 4)::DOUBLE AS success_rate FROM events""")
def q_recent_stats(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    ok = F.count(F.when(F.col("event_type") != "error", 1))
    joined = t.events.crossJoin(F.broadcast(last))  # one row
    return joined.agg(F.date_trunc("day", F.max("last")).alias("last_day"), F.count(F.lit(1)).alias("total"), ok.alias("ok"), F.count(F.when(F.col("ts") >= F.col("last") - F.expr("interval 24 hours"), 1)).alias("recent"), F.round(ok * 100.0 / F.count(F.lit(1)), 4).alias("success_rate"))
