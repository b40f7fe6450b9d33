"""Band joins, sketches, tag patterns, alignment, stateful streams, catalog tables, table functions, depths and model selection."""

from __future__ import annotations

import atexit
import uuid

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import similarity as S
from tidemark.functions.tables import NgramSpans, chunked
from tidemark.functions.tags import tag_spans, tags_kept
from tidemark.operators import graph as G
from tidemark.operators import pipelines as P
from tidemark.operators import selection
from tidemark.operators.bands import band_aggregate, band_join
from tidemark.operators.sketches import merged, quantiles, sketch
from tidemark.plans.learning import _inputs, rows
from tidemark.plans.registry import Tables, query
from tidemark.sources import catalog
from tidemark.streaming.stateful import attributed, closed_sessions, stream_to_table

# look-back joins over a range


@query("""SELECT a.o_custkey, a.o_orderdate, count(*) AS n_before, round(sum(b.o_totalprice), 2) AS total_before FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) a
JOIN orders b ON a.o_custkey = b.o_custkey AND date_diff('day', b.o_orderdate, a.o_orderdate) BETWEEN 1 AND 90 GROUP BY 1, 2""")
def q_lookback_range(t: Tables) -> DataFrame:
    """Orders of the same customer in the 90 days before each day on which the customer ordered."""
    o = t.orders.select("o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("day"), "o_totalprice")
    folds = {"n": F.count(F.lit(1)), "total": F.sum("o_totalprice")}
    out = band_aggregate(o, o, ["o_custkey"], "day", 1, 90, folds, {"n_before": F.sum("r_n"), "total_before": F.sum("r_total")})
    return out.select("o_custkey", F.date_from_unix_date(F.col("day").cast("int")).cast(t.orders.schema["o_orderdate"].dataType).alias("o_orderdate"), "n_before", F.round("total_before", 2).alias("total_before"))


@query("""SELECT a.event_id AS first_id, b.event_id AS then_id, epoch_us(b.ts) - epoch_us(a.ts) AS gap_us FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 1 AND 5400000000""")
def q_band_pairs(t: Tables) -> DataFrame:
    """Clicks of a user within an hour and a half after a view, to the microsecond."""
    e = t.events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    pairs = band_join(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"], "us", 1, 5_400_000_000)
    return pairs.select(F.col("r_event_id").alias("first_id"), F.col("event_id").alias("then_id"), (F.col("us") - F.col("r_us")).alias("gap_us"))


# sketches

_PROBABILITIES = [0.0, 0.01, 0.05, 0.1, 0.5, 0.9, 0.99, 1.0]


@query(f"""SELECT event_type, p, count(value) AS n, CASE p WHEN 0 THEN min(value) WHEN 1 THEN max(value) END AS edge, true AS within FROM events, (SELECT CAST(unnest({_PROBABILITIES}) AS DOUBLE) AS p) GROUP BY event_type, p""")
def q_approx_quantiles(t: Tables) -> DataFrame:
    """Quantiles from sketches of single days merged to the whole, and whether each one's exact rank is within 0.05."""
    e = t.events.select("event_type", F.to_date("ts").alias("day"), "value")
    whole = merged(sketch(e, ["event_type", "day"], "value"), ["event_type"])
    q = quantiles(whole, ["event_type"], _PROBABILITIES)
    below = e.join(F.broadcast(q), "event_type").groupBy("event_type", "p", q["value"].alias("q"), "n")  # a row for each type and probability is sent
    ranked = below.agg(F.avg((e["value"] < q["value"]).cast("int")).alias("low"), F.avg((e["value"] <= q["value"]).cast("int")).alias("high"))
    edge = F.when(F.col("p").isin(0.0, 1.0), F.col("q"))
    return ranked.select("event_type", "p", "n", edge.alias("edge"), ((F.col("low") <= F.col("p") + 0.05) & (F.col("high") >= F.col("p") - 0.05)).alias("within"))


# tag patterns; tags come from the form of a token

_LETTERS = {"NUM": "d", "NAME": "N", "SHORT": "s", "WORD": "w"}
_TAG_SQL = "CASE WHEN regexp_matches(x, '^[0-9]') THEN 'd' WHEN regexp_matches(x, '^[A-Z]') THEN 'N' WHEN length(x) <= 3 THEN 's' ELSE 'w' END"
_TOKENS_SQL = r"(SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"


def _tagged(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    tag = lambda x: F.when(x.rlike("^[0-9]"), "NUM").when(x.rlike("^[A-Z]"), "NAME").when(F.length(x) <= 3, "SHORT").otherwise("WORD")
    return t.documents.filter("text is not null").select("doc_id", words.alias("w")).withColumn("tags", F.transform("w", tag))


@query(rf"""WITH k AS (SELECT doc_id, w, array_to_string(list_transform(w, lambda x: {_TAG_SQL}), '') AS s FROM {_TOKENS_SQL}),
m AS (SELECT doc_id, w, s, list_transform(range(1, len(w) + 1), lambda i: s[i] = 'd' OR s[i:i+1] = 'Ns' OR (i > 1 AND s[i-1:i] = 'Ns') OR s[i:i+2] = 'sss' OR (i > 1 AND s[i-1:i+1] = 'sss') OR (i > 2 AND s[i-2:i] = 'sss')) AS gone FROM k)
SELECT doc_id, array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT gone[i]], ' ') AS kept FROM m""")
def q_tags_kept(t: Tables) -> DataFrame:
    """Texts without their numbers, without names before short words, and without runs of three short words."""
    keep = tags_kept([["NUM"], ["NAME", "SHORT"], ["SHORT", "SHORT", "SHORT"]])
    marked = _tagged(t).withColumn("keep", keep("tags"))
    return marked.select("doc_id", F.array_join(F.transform(F.filter(F.arrays_zip("w", "keep"), lambda x: x["keep"]), lambda x: x["w"]), " ").alias("kept"))


@query(rf"""WITH k AS (SELECT doc_id, array_to_string(list_transform(w, lambda x: {_TAG_SQL}), '') AS s FROM {_TOKENS_SQL})
SELECT doc_id, array_to_string(regexp_extract_all(s, 'N[^s]{{0,2}}s[^N]{{0,2}}N'), ' ') AS names, array_to_string(regexp_extract_all(s, 'w[^w]{{0,2}}w[^d]{{0,2}}d'), ' ') AS numbers FROM k""")
def q_tag_spans(t: Tables) -> DataFrame:
    """Spans of two tag patterns with gaps of up to two tokens, as the tags that they cover."""
    spans = tag_spans([["NAME", "SHORT", "NAME"], ["WORD", "WORD", "NUM"]], max_gap=2)
    letter = F.create_map(*[F.lit(x) for kv in _LETTERS.items() for x in kv])
    found = _tagged(t).select("doc_id", F.transform("tags", lambda x: letter[x]).alias("c"), spans("tags").alias("spans"))

    def covered(k: int) -> Column:
        mine = F.filter("spans", lambda s: s["pattern"] == k)
        return F.array_join(F.transform(mine, lambda s: F.array_join(F.slice("c", s["first"] + 1, s["last"] - s["first"] + 1), "")), " ")

    return found.select("doc_id", covered(0).alias("names"), covered(1).alias("numbers"))


@query()
def q_token_alignment(t: Tables) -> DataFrame:
    """Every turn of a conversation against the one before it: aligned words, and Jaccard of their word pairs."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    c = t.conversations.select("conv_id", "turn", words.alias("w"))
    both = c.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn", "w"))).filter("before is not null")
    pairs = lambda a: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(a, i, 2))))
    return both.select("conv_id", "turn", S.token_alignment("before", "w").alias("alignment"), F.round(S.jaccard(pairs(F.col("before")), pairs(F.col("w"))), 6).alias("pairs"))


# streams with state

_GAP = 7200


def _stream(t: Tables) -> DataFrame:
    """The events as a stream of files."""
    # a glob, as a stream's path must be a folder or match files
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value FROM events), b AS (SELECT *, CASE WHEN ms - lag(ms) OVER w < {1000 * _GAP} THEN 0 ELSE 1 END AS first FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM b), g AS (SELECT user_id, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM s GROUP BY user_id, k)
SELECT user_id, start_ms, last_ms, n, total FROM g WHERE last_ms + {1000 * _GAP} <= (SELECT max(ms) - 600000 FROM m)""")
def q_stream_sessions(t: Tables) -> DataFrame:
    """Sessions that a stateful stream closes by timers."""
    out = stream_to_table(t.spark, lambda: closed_sessions(_stream(t), _GAP, "10 minutes"))
    return out.withColumn("total", F.round("total", 4))


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE""")
def q_stream_join(t: Tables) -> DataFrame:
    """Purchases within half an hour of a view, from two streams."""
    plan = lambda: attributed(_stream(t).filter("event_type = 'view'"), _stream(t).filter("event_type = 'purchase'"), "30 minutes", "1 hour")
    return stream_to_table(t.spark, plan).select("user_id", "first_id", "then_id")


# catalog tables

_MONTHS = ["199501", "199502", "199612"]


def _drop_at_exit(spark: SparkSession, table: str) -> str:
    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")

    atexit.register(drop)
    return table


@query(f"SELECT o_orderkey, o_totalprice AS price_amt, strftime(o_orderdate, '%Y%m') AS ym FROM orders WHERE strftime(o_orderdate, '%Y%m') IN ({', '.join(map(repr, _MONTHS))})")
def q_catalog_partitions(t: Tables) -> DataFrame:
    """All orders as a catalog table by month, then three months of the wanted columns that it has."""
    table = _drop_at_exit(t.spark, f"tidemark_orders_{uuid.uuid4().hex[:12]}")
    catalog.save_partitioned(t.orders.withColumn("ym", F.date_format("o_orderdate", "yyyyMM")), table, ["ym"])
    return catalog.read_months(t.spark, table, ["o_orderkey", "o_totalprice as price_amt", "no_such_column", "ym", "o_orderkey"], "ym", _MONTHS)


# table functions


@query("SELECT item_id, CAST(i AS INTEGER) AS word_from, CAST(i + k - 1 AS INTEGER) AS word_to, CAST(k AS INTEGER) AS n_words FROM (SELECT item_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS n FROM benchmark), (SELECT unnest([1, 2, 3]) AS k), (SELECT unnest(range(0, 5000)) AS i) WHERE i + k <= n")
def q_ngram_spans(t: Tables) -> DataFrame:
    """Word windows by a table function over the table partitioned by item."""
    source = t.benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").alias("body"))
    return NgramSpans(source.asTable().partitionBy("id")).select(F.col("id").alias("item_id"), "word_from", "word_to", "n_words")


@query()
def q_chunk_table(t: Tables) -> DataFrame:
    return chunked(t.documents, "doc_id", "text", 1000, 100)


# depths of graphs

_DEPTH_EDGES = """(SELECT DISTINCT 'type' AS graph, 't' || a AS src, 't' || b AS dst FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE a <> b
UNION ALL SELECT 'heap', 'p' || (p_partkey // 2), 'p' || p_partkey FROM part WHERE p_partkey // 2 <> p_partkey UNION ALL SELECT 'type', 'root', 'tview')"""


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_DEPTH_EDGES}), c AS (SELECT src, dst FROM e WHERE graph = 'type' UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src AND e.graph = 'type'),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), blocked AS (SELECT DISTINCT y.dst AS node FROM c x JOIN c y ON x.src = x.dst AND y.src = x.src),
w AS (SELECT node, CAST(0 AS INTEGER) AS k FROM n WHERE node NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, w.k + 1 FROM w JOIN e ON w.node = e.src WHERE e.dst NOT IN (SELECT node FROM blocked))
SELECT node, max(k) AS depth FROM n LEFT JOIN w USING (node) GROUP BY node""")
def q_graph_depths(t: Tables) -> DataFrame:
    """Depths in a tree over all parts and in the cyclic graph of event types that follow one another."""
    then = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    types = t.events.select(F.concat(F.lit("t"), "event_type").alias("src"), F.concat(F.lit("t"), then).alias("dst")).filter("dst <> src").distinct()
    up = F.floor(F.col("p_partkey") / 2)
    heap = t.part.select(F.concat(F.lit("p"), up).alias("src"), F.concat(F.lit("p"), "p_partkey").alias("dst")).filter("src <> dst")
    root = t.spark.createDataFrame([("root", "tview")], "src string, dst string")
    return G.depths(types.unionByName(heap).unionByName(root))


# model selection


@query()
def q_model_selection(t: Tables) -> DataFrame:
    """Mean ROC AUC of each setting over folds of users."""
    df = rows(t)
    features = P.feature_pipeline(_inputs(df).drop("app_usage_token"), scale=False)
    model = P.classifier("gbt", "label", iterations=3, depth=2)
    grid = ParamGridBuilder().addGrid(model.maxDepth, [2, 3]).addGrid(model.maxIter, [2, 4]).build()
    found = selection.cross_validate(df.withColumn("label", F.col("label").cast("double")), [*features.getStages(), model], grid, ["user_id"], "label", folds=2)
    best = max(range(len(grid)), key=lambda k: found.avgMetrics[k])
    out = [(g[model.maxDepth], g[model.maxIter], round(float(m), 6), k == best) for k, (g, m) in enumerate(zip(grid, found.avgMetrics))]
    return t.spark.createDataFrame(out, "max_depth int, max_iter int, roc_auc double, best boolean")
