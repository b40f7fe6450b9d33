"""Ranking, calibration and classification metrics over a deterministic score per user and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranking as R
from tidemark.plans.registry import Tables, query

_ROWS = "(SELECT event_id, user_id, CAST(hour(ts) AS INTEGER) AS h, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS prob, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS label FROM events WHERE hour(ts) BETWEEN 9 AND 18)"
_UH = f"(SELECT user_id, h, max(prob) AS prob, max(label) AS label FROM {_ROWS} GROUP BY 1, 2)"
_P = "least(greatest(prob, 1e-12), 1 - 1e-12)"


def scored(t: Tables) -> DataFrame:
    e = t.events.filter(F.hour("ts").between(9, 18))
    prob = (F.col("event_id") * 7919 % 1000) / F.lit(1000.0)
    return e.select("event_id", "user_id", F.hour("ts").alias("h"), prob.alias("prob"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("label"))


def user_hours(t: Tables) -> DataFrame:
    return scored(t).groupBy("user_id", "h").agg(F.max("prob").alias("prob"), F.max("label").alias("label"))


@query(f"SELECT user_id, h, prob, label FROM {_UH}")
def q_user_hour_max(t: Tables) -> DataFrame:
    return user_hours(t)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY prob DESC, user_id) AS k FROM {_UH}), x AS (SELECT h, sum(CASE WHEN k <= 50 THEN label END) * 1.0 / count(CASE WHEN k <= 50 THEN 1 END) AS p,
  CASE WHEN sum(label) = 0 THEN 0 ELSE sum(CASE WHEN k <= 50 THEN label END) * 1.0 / sum(label) END AS r FROM r GROUP BY h), m AS (SELECT sum(p) / 10 AS p, sum(r) / 10 AS r FROM x)
SELECT 50 AS k, round(p, 6)::DOUBLE AS precision_at_k, round(r, 6)::DOUBLE AS recall_at_k, round(2 * p * r / (p + r), 6)::DOUBLE AS f1 FROM m""")
def q_precision_recall_at_k(t: Tables) -> DataFrame:
    """Means over the ten fixed hours, empty ones included."""
    k = 50
    per = R.top_k(user_hours(t), "h", [F.desc("prob"), F.asc("user_id")], "label", k)
    m = per.agg((F.sum("p") / 10).alias("p"), (F.sum("r") / 10).alias("r"))
    return m.select(F.lit(k).alias("k"), F.round("p", 6).alias("precision_at_k"), F.round("r", 6).alias("recall_at_k"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 6).alias("f1"))


_AP = "SELECT {key}, sum(CASE WHEN label = 1 THEN seen * 1.0 / k END) / sum(label) AS ap FROM (SELECT *, sum(label) OVER (PARTITION BY {key} ORDER BY prob DESC, {tie} ROWS UNBOUNDED PRECEDING) AS seen, row_number() OVER (PARTITION BY {key} ORDER BY prob DESC, {tie}) AS k FROM " + _UH + ") GROUP BY {key} HAVING sum(label) > 0"
_AP_HOUR, _AP_USER = _AP.format(key="h", tie="user_id"), _AP.format(key="user_id", tie="h")


def average_precision(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """AP of each key with a positive label, for keys of few rows: a window a key."""
    w = Window.partitionBy(key).orderBy(F.desc("prob"), tie)
    at = rows.withColumn("seen", F.sum("label").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(w))
    return at.groupBy(key).agg((F.sum(F.when(F.col("label") == 1, F.col("seen") / F.col("k"))) / F.sum("label")).alias("ap"), F.sum("label").alias("n")).filter("n > 0").select(key, "ap")


@query(f"SELECT h, round(ap, 6)::DOUBLE AS ap, round(avg(ap) OVER (), 6)::DOUBLE AS map FROM ({_AP_HOUR})")
def q_map_by_hour(t: Tables) -> DataFrame:
    ap = R.average_precision(user_hours(t), "h", [F.desc("prob"), F.asc("user_id")], "label")  # ten rows at most
    return ap.select("h", F.round("ap", 6).alias("ap"), F.round(F.avg("ap").over(Window.partitionBy(F.lit(0))), 6).alias("map"))


@query(f"SELECT user_id, round(ap, 6)::DOUBLE AS ap FROM ({_AP_USER})")
def q_user_map(t: Tables) -> DataFrame:
    return average_precision(user_hours(t), "user_id", "h").withColumn("ap", F.round("ap", 6))


@query(f"SELECT user_id, round(ap, 6)::DOUBLE AS ap FROM ({_AP_USER})")
def q_hof_user_ap(t: Tables) -> DataFrame:
    """The same by higher-order functions over each user's at most ten hours."""
    lists = user_hours(t).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), "h", "label"))).alias("a")).filter(F.exists("a", lambda x: x["label"] == 1))
    hits = F.expr("transform(sequence(1, size(a)), i -> if(a[i - 1].label = 1, aggregate(slice(a, 1, i), 0, (s, x) -> s + x.label) / i, 0.0D))")
    total = F.expr("aggregate(a, 0, (s, x) -> s + x.label)")
    return lists.select("user_id", F.round(F.aggregate(hits, F.lit(0.0), lambda s, x: s + x) / total, 6).alias("ap"))


@query(f"SELECT floor(round(ap, 9) * 10) / 10.0::DOUBLE AS bucket, count(*) AS n FROM ({_AP_USER}) GROUP BY 1")
def q_ap_buckets(t: Tables) -> DataFrame:
    ap = average_precision(user_hours(t), "user_id", "h")
    return ap.groupBy((F.floor(F.round("ap", 9) * 10) / F.lit(10.0)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prob DESC, h) AS k FROM {_UH}), u AS (SELECT user_id, max(CASE WHEN k = 1 THEN label END) AS t1, max(CASE WHEN k <= 3 THEN label END) AS t3 FROM r GROUP BY 1 HAVING max(label) = 1)
SELECT count(*) AS n, round(avg(t1), 6) AS top1, round(avg(t3), 6) AS top3 FROM u""")
def q_top1_top3_hit(t: Tables) -> DataFrame:
    r = user_hours(t).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("prob"), "h")))
    u = r.groupBy("user_id").agg(F.max(F.when(F.col("k") == 1, F.col("label"))).alias("t1"), F.max(F.when(F.col("k") <= 3, F.col("label"))).alias("t3"), F.max("label").alias("any")).filter("any = 1")
    return u.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("t1"), 6).alias("top1"), F.round(F.avg("t3"), 6).alias("top3"))


@query(f"SELECT floor(prob * 20) / 20.0::DOUBLE AS bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(label), 6) AS mean_label FROM {_ROWS} GROUP BY 1")
def q_calibration_bins(t: Tables) -> DataFrame:
    return scored(t).groupBy((F.floor(F.col("prob") * 20) / F.lit(20.0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.round(F.avg("label"), 6).alias("mean_label"))


@query(f"""SELECT t.th AS threshold, CAST(sum(CASE WHEN prob >= th AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN prob >= th AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN prob < th AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN prob < th AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM {_ROWS}, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(th) GROUP BY 1""")
def q_confusion_thresholds(t: Tables) -> DataFrame:
    s = scored(t).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75)))))
    yes, pos = F.col("prob") >= F.col("threshold"), F.col("label") == 1
    n = lambda c: F.count(F.when(c, 1))
    return s.groupBy("threshold").agg(n(yes & pos).alias("tp"), n(yes & ~pos).alias("fp"), n(~yes & pos).alias("fn"), n(~yes & ~pos).alias("tn"))


@query(f"""WITH c AS (SELECT sum(CASE WHEN prob >= 0.5 AND label = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN prob >= 0.5 AND label = 0 THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN prob < 0.5 AND label = 1 THEN 1.0 ELSE 0 END) AS fn, count(*) AS n FROM {_ROWS})
SELECT round(tp / (tp + fp), 6)::DOUBLE AS "precision", round(tp / (tp + fn), 6)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1, round((n - fp - fn) / n, 6)::DOUBLE AS accuracy FROM c""")
def q_binary_metrics(t: Tables) -> DataFrame:
    yes, pos = F.col("prob") >= 0.5, F.col("label") == 1
    n = lambda c: F.count(F.when(c, 1))
    c = scored(t).agg(n(yes & pos).alias("tp"), n(yes & ~pos).alias("fp"), n(~yes & pos).alias("fn"), F.count(F.lit(1)).alias("n"))
    return c.selectExpr("round(tp / (tp + fp), 6) as `precision`", "round(tp / (tp + fn), 6) as recall", "round(2 * tp / (2 * tp + fp + fn), 6) as f1", "round((n - fp - fn) / n, 6) as accuracy")


@query(f"""SELECT round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6)::DOUBLE AS auc FROM (SELECT label, avg(k) OVER (PARTITION BY prob) AS r FROM (SELECT label, prob, row_number() OVER (ORDER BY prob) AS k FROM {_ROWS}))""")
def q_auc_ranksum(t: Tables) -> DataFrame:
    return R.auc(scored(t), "prob", "label").select(F.round("auc", 6).alias("auc"))


@query(f"""SELECT 200 AS k, round((SELECT avg(label) FROM (SELECT label FROM {_ROWS} ORDER BY prob DESC, event_id LIMIT 200)) / avg(label), 6) AS lift FROM {_ROWS}""")
def q_topk_lift(t: Tables) -> DataFrame:
    s = scored(t)
    top = s.orderBy(F.desc("prob"), "event_id").limit(200).agg(F.avg("label").alias("top"))
    return s.agg(F.avg("label").alias("base")).crossJoin(top).select(F.lit(200).alias("k"), F.round(F.col("top") / F.col("base"), 6).alias("lift"))


@query(f"SELECT h, count(*) AS n, CAST(sum(label) AS BIGINT) AS clicks, round(avg(label), 6) AS rate FROM {_ROWS} GROUP BY 1")
def q_hour_rate(t: Tables) -> DataFrame:
    return scored(t).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("clicks"), F.round(F.avg("label"), 6).alias("rate"))


@query(f"SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg, round((count(*) - sum(label)) * 1.0 / sum(label), 6)::DOUBLE AS neg_per_pos FROM {_ROWS}")
def q_class_balance(t: Tables) -> DataFrame:
    return scored(t).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).selectExpr("n", "pos", "n - pos as neg", "round((n - pos) / pos, 6) as neg_per_pos")


@query(f"SELECT event_id, round((({_P}) / (1 - {_P}) * (0.05 * 0.5) / (0.5 * 0.95)) / (1 + ({_P}) / (1 - {_P}) * (0.05 * 0.5) / (0.5 * 0.95)), 6)::DOUBLE AS corrected FROM {_ROWS}")
def q_prior_correction(t: Tables) -> DataFrame:
    """Probabilities of a model trained at prior 0.5, moved to prior 0.05 through the odds."""
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = p / (1 - p) * F.lit(0.05 * 0.5) / F.lit(0.5 * 0.95)
    return scored(t).select("event_id", F.round(odds / (1 + odds), 6).alias("corrected"))


@query(f"SELECT event_id, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE round((0.95 / 0.05) / (0.5 / 0.5), 6)::DOUBLE END AS weight FROM {_ROWS}")
def q_class_weight(t: Tables) -> DataFrame:
    return scored(t).select("event_id", F.when(F.col("label") == 1, 1.0).otherwise(F.round(F.lit(0.95 / 0.05) / F.lit(1.0), 6)).alias("weight"))


@query(f"SELECT user_id, h, round(prob * (1 - prob) , 4) AS propensity FROM {_UH}")
def q_propensity_product(t: Tables) -> DataFrame:
    parts = F.array("prob", 1 - F.col("prob"))
    return user_hours(t).select("user_id", "h", F.round(F.aggregate(parts, F.lit(1.0), lambda a, x: a * x), 4).alias("propensity"))
