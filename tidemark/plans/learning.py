"""Feature pipelines, models and evaluators; their results have no SQL form."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import pipelines as P
from tidemark.plans.registry import Tables, query


def rows(t: Tables) -> DataFrame:
    """One row per user and hour: tokens, categories, numbers and two labels."""
    e = t.events.groupBy("user_id", F.hour("ts").alias("send_hour")).agg(
        F.array_sort(F.collect_list("event_type")).alias("app_usage_token"),
        F.max("event_type").alias("last_cd"),
        F.sum("value").alias("traffic_amt"),
        F.count(F.lit(1)).alias("event_cnt"),
        F.max(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("label"),
        F.avg("value").alias("utility"),
    )
    return e.withColumns({"traffic_amt": F.col("traffic_amt").cast("float"), "event_cnt": F.col("event_cnt").cast("float")})


def _inputs(df: DataFrame) -> DataFrame:
    return df.select("app_usage_token", "last_cd", "traffic_amt", "event_cnt")


@query()
def q_feature_vectors(t: Tables) -> DataFrame:
    df = rows(t)
    model = P.feature_pipeline(_inputs(df), one_hot=("last_cd",)).fit(df)
    out = model.transform(df)
    return out.select("user_id", "send_hour", F.size(P.vector_to_array("features")).alias("n_features"), F.round(F.aggregate(P.vector_to_array("features"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query()
def q_word_embedding(t: Tables) -> DataFrame:
    df = rows(t)
    model = P.feature_pipeline(_inputs(df), embed=True, scale=False).fit(df)
    return model.transform(df).select("user_id", "send_hour", F.size(P.vector_to_array("features")).alias("n_features"))


@query()
def q_click_model_scores(t: Tables) -> DataFrame:
    """Fits the click model and its gap model, and multiplies their probabilities."""
    df = rows(t)
    features = P.feature_pipeline(_inputs(df), scale=False).fit(df).transform(df).select("user_id", "send_hour", "label", "utility", "features").cache()
    fast = (F.col("utility") > 50).cast("int")
    click = P.score(P.classifier("gbt", "label", iterations=5, depth=3).fit(features), features, "prob_click")
    gap = features.withColumn("fast_click", fast)
    gap = P.score(P.classifier("fm", "fast_click", iterations=20).fit(gap), gap, "prob_gap")
    return P.propensity(click, gap, ["user_id", "send_hour"])


@query()
def q_model_quality(t: Tables) -> DataFrame:
    df = rows(t)
    features = P.feature_pipeline(_inputs(df), scale=False).fit(df).transform(df).cache()
    part = F.pmod(F.xxhash64("user_id"), F.lit(5))
    train, test = features.filter(part > 0), features.filter(part == 0)
    scored = P.classifier("gbt", "label", iterations=5, depth=3).fit(train).transform(test)
    auc = [BinaryClassificationEvaluator(labelCol="label", metricName=m).evaluate(scored) for m in ("areaUnderROC", "areaUnderPR")]
    predicted = P.regressor("utility", iterations=5, depth=3).fit(train).transform(test)
    rmse = RegressionEvaluator(labelCol="utility", metricName="rmse").evaluate(predicted)
    return t.spark.createDataFrame([(float(auc[0]), float(auc[1]), float(rmse))], "roc_auc double, pr_auc double, rmse double")
