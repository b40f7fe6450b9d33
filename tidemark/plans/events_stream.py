"""Event-time windows; extensions beside the operators for response data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import Tables, query
from tidemark.streaming.events import sessions, tumbling


def _timed(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS w, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def q_tumbling_windows(t: Tables) -> DataFrame:
    return tumbling(_timed(t), "6 hours").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n"))


@query("""SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def q_session_windows(t: Tables) -> DataFrame:
    return sessions(_timed(t), "2 hours").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n"))
