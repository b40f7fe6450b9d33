"""Shards and samples by key, guarded timestamps, further string matching, vocabulary rows, catalog scans."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import similarity as S
from tidemark.functions import text as X
from tidemark.operators import graph as G
from tidemark.operators import samples as H
from tidemark.operators.blocking import candidates
from tidemark.plans.registry import Tables, query


@query("SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '%1' OR CAST(c_custkey AS VARCHAR) LIKE '%5' OR CAST(c_custkey AS VARCHAR) LIKE '%9'")
def q_suffix_filter(t: Tables) -> DataFrame:
    return t.customer.filter(H.suffix(F.col("c_custkey")).isin("1", "5", "9")).select("c_custkey", "c_name")


@query("SELECT right(sha256(c_name), 1) AS suffix, count(*) AS n, sum(c_acctbal)::DOUBLE AS balance FROM (SELECT c_name, round(c_acctbal) AS c_acctbal FROM customer) GROUP BY 1")
def q_suffix_shards(t: Tables) -> DataFrame:
    """Sixteen shards by the last hex digit of the hashed key, in one pass in place of a loop."""
    rows = t.customer.select(H.suffix(F.sha2("c_name", 256)).alias("suffix"), F.round("c_acctbal").alias("b"))
    return rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("b").cast("double").alias("balance"))


_DT = "strftime(ts, '%Y%m%d') AS dt, CAST(CAST(strftime(ts, '%H%M%S') AS INTEGER) AS VARCHAR) AS tm"


@query(f"SELECT event_id, CASE WHEN length(dt) = 8 AND length(tm) = 6 THEN CAST(epoch(strptime(dt || tm, '%Y%m%d%H%M%S')) AS BIGINT) END AS at FROM (SELECT event_id, {_DT} FROM events)")
def q_guarded_timestamp(t: Tables) -> DataFrame:
    """Date and time texts count only at their full lengths; others give null, never an error."""
    dt, tm = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss").cast("int").cast("string")
    parsed = F.unix_timestamp(F.try_to_timestamp(F.concat(dt, tm), F.lit("yyyyMMddHHmmss")))
    return t.events.select("event_id", F.when((F.length(dt) == 8) & (F.length(tm) == 6), parsed).alias("at"))


@query(f"SELECT o_orderkey FROM orders WHERE substr(md5('46:' || o_orderkey), 1, 8) < '{H.below(0.3)}'")
def q_sample(t: Tables) -> DataFrame:
    return H.hash_sample(t.orders, "o_orderkey", 0.3, 46).select("o_orderkey")


_BY = {"click": 1.0, "view": 0.25, "purchase": 0.5}


@query(f"SELECT event_id, event_type FROM events WHERE substr(md5('46:' || event_id), 1, 8) < CASE event_type {' '.join(f"WHEN '{k}' THEN '{H.below(v)}'" for k, v in _BY.items())} ELSE '' END")
def q_sample_by(t: Tables) -> DataFrame:
    return H.hash_sample_by(t.events, "event_id", "event_type", _BY, 46).select("event_id", "event_type")


@query("""WITH i AS (SELECT p_name AS item_nm, CAST(p_partkey AS VARCHAR) AS item_id, substr(p_type, 1, 1) AS item_dmn FROM part
UNION ALL SELECT * FROM (VALUES ('my plan', 'user_0', 'user_defined'), ('test plan', 'user_1', 'user_defined'), ('gear plan', 'user_2', 'user_defined')) v(item_nm, item_id, item_dmn))
SELECT item_nm, item_id, item_dmn, CASE item_dmn WHEN 'P' THEN 'product' WHEN 'E' THEN 'device' WHEN 'S' THEN 'subscription' ELSE 'other' END AS item_dmn_nm FROM i WHERE NOT contains(upper(item_nm), 'TEST')""")
def q_item_vocabulary(t: Tables) -> DataFrame:
    """Items and user-defined rows with their domain names, without test items; a null name stays."""
    own = t.spark.createDataFrame([(n, f"user_{i}", "user_defined") for i, n in enumerate(("my plan", "test plan", "gear plan"))], "item_nm string, item_id string, item_dmn string")
    items = t.part.select(F.col("p_name").alias("item_nm"), F.col("p_partkey").cast("string").alias("item_id"), F.substring("p_type", 1, 1).alias("item_dmn")).unionByName(own)
    named = F.create_map(*[F.lit(x) for kv in (("P", "product"), ("E", "device"), ("S", "subscription")) for x in kv])
    kept = items.filter(~F.coalesce(F.contains(F.upper("item_nm"), F.lit("TEST")), F.lit(False)))
    return kept.withColumn("item_dmn_nm", F.coalesce(F.try_element_at(named, "item_dmn"), F.lit("other")))


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), x AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
k AS (SELECT item_id, w FROM x SEMI JOIN v USING (w) WHERE length(w) >= 2 AND w NOT IN ('the', 'of'))
SELECT item_id, w FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS o WHERE o.item_id = k.item_id AND o.w <> k.w AND contains(o.w, k.w))""")
def q_vocabulary_nouns(t: Tables) -> DataFrame:
    """Words of a text that the vocabulary has, of two letters and more, no stop words, none inside a longer one of the same text."""
    v = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    x = t.benchmark.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    k = x.filter((F.length("w") >= 2) & ~F.col("w").isin("the", "of")).join(v, "w", "left_semi").groupBy("item_id").agg(F.collect_set("w").alias("ws"))
    inside = lambda w: F.exists("ws", lambda o: (o != w) & F.contains(o, w))
    return k.select("item_id", F.explode(F.filter("ws", lambda w: ~inside(w))).alias("w"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS ym FROM orders WHERE strftime(o_orderdate, '%Y%m') IN ('199501', '199502', '199612')")
def q_catalog_months(t: Tables) -> DataFrame:
    """A catalog table read through SQL text with a list of months."""
    t.orders.createOrReplaceTempView("tidemark_orders")
    months = ", ".join(f"'{m}'" for m in ("199501", "199502", "199612"))
    return t.spark.sql(f"SELECT o_orderkey, date_format(o_orderdate, 'yyyyMM') AS ym FROM tidemark_orders WHERE date_format(o_orderdate, 'yyyyMM') IN ({months})")


@query("SELECT item_id, len(string_split(text, ' '))::DOUBLE AS n_terms FROM benchmark WHERE text IS NOT NULL")
def q_hashing_tf(t: Tables) -> DataFrame:
    """Hashed term frequencies; their sum is the number of terms whatever collides."""
    words = t.benchmark.filter("text is not null").select("item_id", F.split("text", " ").alias("words"))
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=1024).transform(words)
    return tf.select("item_id", F.aggregate(vector_to_array("tf"), F.lit(0.0), lambda s, v: s + v).alias("n_terms"))


@query("SELECT '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) || chr(10) || '(3 of 5 rows)' AS prompt FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)")
def q_markdown_table(t: Tables) -> DataFrame:
    return markdown_table(t.region.select("r_regionkey", "r_name"), "r_regionkey", 3)


def markdown_table(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(prompt): the first rows by key as a markdown table, with a note where some are left out."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    top = df.orderBy(key).limit(rows).select(F.struct(F.col(key).alias("k"), cells.alias("line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    body = F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["line"]), "\n"))
    note = F.when(F.col("n") > rows, F.concat(F.lit(f"\n({rows} of "), F.col("n").cast("string"), F.lit(" rows)"))).otherwise(F.lit(""))
    return top.crossJoin(n).select(F.concat(body, note).alias("prompt"))  # one row against one row


# further string matching: no SQL form


def word_pairs(t: Tables) -> DataFrame:
    """Words of the benchmark and item names that share two letter pairs."""
    w = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    n = t.part.select("p_name").distinct()
    return candidates(w, "word", X.bigrams(F.col("word")), n, "p_name", X.bigrams(F.col("p_name")), 2).select("word", "p_name")


@query()
def q_weighted_score(t: Tables) -> DataFrame:
    return word_pairs(t).withColumn("score", S.metric(S.weighted)("word", "p_name"))


@query()
def q_character_similarity(t: Tables) -> DataFrame:
    return word_pairs(t).withColumn("score", S.metric(S.character_similarity)("word", "p_name"))


@query()
def q_fuzzy_topk(t: Tables) -> DataFrame:
    """The five best names of each word at 0.5 and more, equal scores by name."""
    scored = word_pairs(t).withColumn("score", S.metric(S.wide_ratio)("word", "p_name")).filter("score >= 0.5")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "p_name"))).filter("rank <= 5")


@query()
def q_store_match(t: Tables) -> DataFrame:
    """For each word all names that share the best combined score, with their ids: fuzzy 0.5 and combined 0.3 at least."""
    near = word_pairs(t).filter(S.metric(S.fuzzy)("word", "p_name") >= 0.5)
    scored = near.withColumn("score", S.metric(S.combined)("word", "p_name")).filter("score >= 0.3")
    best = scored.withColumn("rank", F.rank().over(Window.partitionBy("word").orderBy(F.desc("score")))).filter("rank = 1")
    ids = t.part.groupBy("p_name").agg(F.array_sort(F.collect_list("p_partkey")).alias("ids"))
    return best.join(ids, "p_name").select("word", "p_name", "score", "ids")


@query()
def q_stop_word_like(t: Tables) -> DataFrame:
    """The words that are no stop word and not like one: matching blocks over 0.95 of the mean length."""
    w = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    stops = t.spark.createDataFrame([(x,) for x in ("the", "and", "information", "registration", "notification", "ing")], "stop string")
    # words so alike share a letter pair, but for words of one letter, which are alike only if equal
    near = candidates(w, "word", X.bigrams(F.col("word")), stops, "stop", X.bigrams(F.col("stop")))
    like = near.filter(S.metric(S.sequence_ratio)("word", "stop") > 0.95).select("word").unionByName(stops.select(F.col("stop").alias("word")))
    return w.join(like, "word", "left_anti")


@query()
def q_html_chunks(t: Tables) -> DataFrame:
    """Pages in chunks of 2,000 characters: by marked products where a page has them, else slices."""
    return t.pages.select("page_id", F.posexplode(X.chunk_html_udf(2000)("html")).alias("chunk_no", "chunk"))


@query()
def q_loose_prf(t: Tables) -> DataFrame:
    """Names of half of each group's parts against those of the other half, matched loosely, each at most once."""
    half = lambda r: F.collect_set(F.when(F.col("p_partkey") % 2 == r, F.col("p_name")))
    sets = t.part.groupBy("p_type", "p_brand").agg(half(0).alias("gold"), half(1).alias("found")).filter(F.size("gold") > 0)
    hits = sets.select("p_type", "p_brand", F.size("gold").alias("n_gold"), F.size("found").alias("n_found"), S.loose_hits(F.col("found"), F.col("gold")).alias("hits"))
    p, r = F.coalesce(F.try_divide("hits", "n_found"), F.lit(0.0)), F.col("hits") / F.col("n_gold")
    return hits.withColumns({"precision": p, "recall": r})


@query("SELECT true AS acyclic")
def q_is_dag(t: Tables) -> DataFrame:
    """Regions hold nations, nations hold suppliers."""
    down = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    edges = down.unionByName(t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst")))
    return t.spark.createDataFrame([(G.is_acyclic(edges),)], "acyclic boolean")
