"""Entity resolution: blocking, string and vector similarity, alias rules, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import similarity as S
from tidemark.functions import text as X
from tidemark.operators import aliases as A
from tidemark.operators.allocation import cut_lineage
from tidemark.operators.blocking import adaptive_cut, candidates
from tidemark.operators.nearest import nearest
from tidemark.plans.registry import Tables, query

_GRAMS = "SELECT k, unnest(list_distinct([substr(s, CAST(i AS INTEGER), 2) FOR i IN range(1, greatest(length(s), 2))])) AS g FROM (SELECT DISTINCT {k} AS k, lower(regexp_replace({v}, '[^가-힣a-zA-Z0-9]', '', 'g')) AS s FROM {t})"
_ITEM = _GRAMS.format(k="item_id", v="text", t="benchmark")
_NAME = _GRAMS.format(k="p_name", v="p_name", t="part")


def names(t: Tables) -> DataFrame:
    return t.part.select("p_name").distinct()


@query(f"SELECT a.k AS item_id, b.k AS p_name, count(*) AS shared FROM ({_ITEM}) a JOIN ({_NAME}) b USING (g) GROUP BY 1, 2 HAVING count(*) >= 3")
def q_bigram_candidates(t: Tables) -> DataFrame:
    return candidates(t.benchmark, "item_id", X.bigrams(X.preprocess(F.col("text"))), names(t), "p_name", X.bigrams(F.col("p_name")), 3)


_WINDOW = "SELECT item_id, w[i] AS win FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark))"


def windows(t: Tables) -> DataFrame:
    return t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("win")).distinct()


def window_names(t: Tables, w: DataFrame) -> DataFrame:
    """Windows and names that share a bigram."""
    return candidates(w, "win", X.bigrams(F.col("win")), names(t), "p_name", X.bigrams(F.col("p_name"))).select("win", "p_name")


@query(f"SELECT DISTINCT win, p_name FROM (SELECT DISTINCT win, substr(win, CAST(j AS INTEGER), 2) AS g FROM ({_WINDOW}), unnest(range(1, greatest(length(win), 2))) r(j)) x JOIN (SELECT k AS p_name, g FROM ({_NAME})) USING (g)")
def q_bigram_equi_join(t: Tables) -> DataFrame:
    return window_names(t, windows(t))


_SIZES = f"SELECT k, count(*) AS n FROM ({_NAME}) GROUP BY 1"


def name_pairs(t: Tables) -> DataFrame:
    """Pairs of different names that share a bigram, the smaller name first."""
    a = names(t).withColumnRenamed("p_name", "a")
    b = names(t).withColumnRenamed("p_name", "b")
    return candidates(a, "a", X.bigrams(F.col("a")), b, "b", X.bigrams(F.col("b"))).filter("a < b")


@query(f"""SELECT a, b, round(s * 1.0 / (x.n + y.n - s), 6)::DOUBLE AS jaccard FROM (SELECT p.k AS a, q.k AS b, count(*) AS s FROM ({_NAME}) p JOIN ({_NAME}) q USING (g) WHERE p.k < q.k GROUP BY 1, 2) JOIN ({_SIZES}) x ON x.k = a JOIN ({_SIZES}) y ON y.k = b""")
def q_jaccard_bigrams(t: Tables) -> DataFrame:
    return name_pairs(t).select("a", "b", F.round(S.jaccard(X.bigrams(F.col("a")), X.bigrams(F.col("b"))), 6).alias("jaccard"))


@query(f"""SELECT a, b, round(s / sqrt(x.n * y.n), 6) AS cosine FROM (SELECT p.k AS a, q.k AS b, count(*) AS s FROM ({_NAME}) p JOIN ({_NAME}) q USING (g) WHERE p.k < q.k GROUP BY 1, 2) JOIN ({_SIZES}) x ON x.k = a JOIN ({_SIZES}) y ON y.k = b""")
def q_cosine_ngrams(t: Tables) -> DataFrame:
    a, b = X.bigrams(F.col("a")), X.bigrams(F.col("b"))
    return name_pairs(t).select("a", "b", F.round(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)), 6).alias("cosine"))


@query(f"""SELECT a, b, round(1 - levenshtein(a, b) * 1.0 / greatest(length(a), length(b)), 6)::DOUBLE AS sim FROM (SELECT DISTINCT p.k AS a, q.k AS b FROM ({_NAME}) p JOIN ({_NAME}) q USING (g) WHERE p.k < q.k)""")
def q_levenshtein_sim(t: Tables) -> DataFrame:
    return name_pairs(t).select("a", "b", F.round(S.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query()
def q_lcs_ratio(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    out = {"fuzzy": S.metric(S.fuzzy), "lcs": S.metric(S.lcs_ratio), "blocks": S.metric(S.block_ratio), "combined": S.metric(S.combined)}
    return name_pairs(t).select("a", "b", *[f(a, b).alias(n) for n, f in out.items()])


@query()
def q_entity_match(t: Tables) -> DataFrame:
    """Words of the benchmark against item names: fuzzy, then two-sided scores, then rank."""
    w = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("win")).distinct()
    c = candidates(w, "win", X.bigrams(F.col("win")), names(t), "p_name", X.bigrams(F.col("p_name")), 2)
    near = c.withColumn("fuzzy", S.metric(S.fuzzy)("win", "p_name")).filter("fuzzy >= 0.4")
    two = near.withColumn("s1", S.metric(S.combined, "s1")("win", "p_name")).withColumn("s2", S.metric(S.combined, "s2")("win", "p_name"))
    kept = two.filter("s1 >= 0.2 and s2 >= 0.2").withColumn("score", F.col("s1") + F.col("s2"))
    return kept.withColumn("rank", F.dense_rank().over(Window.partitionBy("win").orderBy(F.desc("score")))).filter("rank <= 3").select("win", "p_name", "score", "rank")


_J = "(SELECT a, b, round(s * 1.0 / (x.n + y.n - s), 6)::DOUBLE AS j FROM (SELECT p.k AS a, q.k AS b, count(*) AS s FROM (" + _NAME + ") p JOIN (" + _NAME + ") q USING (g) WHERE p.k <> q.k GROUP BY 1, 2) JOIN (" + _SIZES + ") x ON x.k = a JOIN (" + _SIZES + ") y ON y.k = b)"


def scored_pairs(t: Tables) -> DataFrame:
    a, b = names(t).withColumnRenamed("p_name", "a"), names(t).withColumnRenamed("p_name", "b")
    p = candidates(a, "a", X.bigrams(F.col("a")), b, "b", X.bigrams(F.col("b"))).filter("a <> b")
    return p.select("a", "b", F.round(S.jaccard(X.bigrams(F.col("a")), X.bigrams(F.col("b"))), 6).alias("j"))


@query(f"""WITH p AS (SELECT *, j >= greatest(0.4, 0.85 * max(j) OVER (PARTITION BY a)) AS ok, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS n FROM {_J}), q AS (SELECT *, max(CAST(ok AS INTEGER)) OVER (PARTITION BY a) AS has_ok FROM p)
SELECT a, b, j FROM q WHERE (has_ok = 1 AND ok AND n <= 5) OR (has_ok = 0 AND n <= 3)""")
def q_adaptive_cut(t: Tables) -> DataFrame:
    return adaptive_cut(scored_pairs(t), "a", "j", [F.asc("b")], 0.4)


@query(f"""SELECT a, b, j FROM (SELECT *, dense_rank() OVER (PARTITION BY a ORDER BY j DESC) AS ra, dense_rank() OVER (PARTITION BY b ORDER BY j DESC) AS rb FROM {_J}) WHERE ra = 1 AND rb = 1""")
def q_mutual_best_match(t: Tables) -> DataFrame:
    r = lambda k: F.dense_rank().over(Window.partitionBy(k).orderBy(F.desc("j")))
    return scored_pairs(t).withColumn("ra", r("a")).withColumn("rb", r("b")).filter("ra = 1 and rb = 1").select("a", "b", "j")


@query("SELECT DISTINCT conv_id, turn, w AS token, n_names FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) JOIN (SELECT w, count(DISTINCT p_name) AS n_names FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1) USING (w)")
def q_inverted_index(t: Tables) -> DataFrame:
    index = names(t).select(F.explode(F.split("p_name", " ")).alias("token"), "p_name").groupBy("token").agg(F.count_distinct("p_name").alias("n_names"))
    w = t.conversations.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    return w.join(index, "token").select("conv_id", "turn", "token", "n_names")


@query("SELECT DISTINCT p_brand, p_type, word FROM part, (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE contains(p_name, word)")
def q_containment_join(t: Tables) -> DataFrame:
    """Names are cut into words and joined by word: equal to containment, as names and aliases are whole words."""
    words = names(t).select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    mine = t.part.select("p_brand", "p_type", F.explode(F.split("p_name", " ")).alias("part_word")).distinct()
    # the vocabulary is blocked by first letters inside the name's own words
    pairs = mine.select("part_word").distinct().select("part_word", F.explode(X.char_ngrams(F.col("part_word"), 3)).alias("g")).join(words.select("word", F.substring("word", 1, 3).alias("g")), "g").filter(F.contains("part_word", F.col("word")))
    return mine.join(pairs.select("part_word", "word").distinct(), "part_word").select("p_brand", "p_type", "word").distinct()


@query("""WITH w AS (SELECT item_id, regexp_extract_all(text, '[^ \\n]+') AS w FROM benchmark) SELECT item_id, CAST(i AS INTEGER) AS start, CAST(n AS INTEGER) AS n, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM w, range(1, 5) r(n) WHERE len(w) >= n)""".replace("\\\\n", "\\n"))
def q_token_windows(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)).alias("w"))
    g = words.select("item_id", F.inline(X.word_ngrams(F.col("w"), 1, 4)))
    return g.select("item_id", "start", (F.col("end") - F.col("start")).alias("n"), F.col("gram").alias("win"))


@query("""WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT label, list_transform(range(1, 65), i -> 0.0) AS z FROM embeddings GROUP BY 1),
x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), d AS (SELECT vec_id, x.label, sum(e[i] * m) / sqrt(sum(CAST(e[i] AS DOUBLE) * e[i]) * sum(m * m)) AS s FROM q, x GROUP BY 1, 2)
SELECT vec_id, label, round(s, 5) AS sim, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS r FROM d) WHERE r <= 3""")
def q_cosine_topk(t: Tables) -> DataFrame:
    """A stated set of query vectors against all class centres; there are as many centres as labels."""
    centres = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    q = t.embeddings.filter("vec_id % 20 = 0").select("vec_id", "embedding")
    s = q.crossJoin(centres).withColumn("s", S.cosine(F.col("embedding"), F.col("m")))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s")))).filter("rank <= 3").select("vec_id", "label", F.round("s", 5).alias("sim"), "rank")


_TF = "SELECT conv_id, w, count(*) AS tf FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[^ .,\\n]+')) AS w FROM conversations) GROUP BY 1, 2"


@query(f"""WITH tf AS ({_TF}), n AS (SELECT count(DISTINCT conv_id) AS n FROM tf), idf AS (SELECT w, ln((1 + n) * 1.0 / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY w, n), v AS (SELECT conv_id, w, tf * idf AS x FROM tf JOIN idf USING (w)),
l AS (SELECT conv_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1), s AS (SELECT a.conv_id AS q, b.conv_id AS d, sum(a.x * b.x) AS s FROM v a JOIN v b USING (w) WHERE a.conv_id % 20 = 0 AND a.conv_id <> b.conv_id GROUP BY 1, 2)
SELECT q, d, round(s / (x.l * y.l), 5) AS sim FROM s JOIN l x ON x.conv_id = q JOIN l y ON y.conv_id = d QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s / (x.l * y.l), 9) DESC, d) <= 3""")
def q_tfidf_topk(t: Tables) -> DataFrame:
    """The stated queries (ids divisible by 20) against all conversations."""
    tf = t.conversations.select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[^ .,\n]+"), F.lit(0))).alias("w")).groupBy("conv_id", "w").agg(F.count(F.lit(1)).alias("tf"))
    n = t.conversations.filter(F.col("text").rlike("[^ .,\n]")).agg(F.count_distinct("conv_id").alias("n"))
    idf = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("w", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    v = tf.filter("conv_id is not null").join(idf, "w").select(F.col("conv_id").alias("id"), "w", (F.col("tf") * F.col("idf")).alias("x"))
    entries = F.collect_list(F.struct("w", "x"))
    vectors = v.groupBy("id").agg(entries.alias("e"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size")).select("id", F.col("e.w").alias("words"), F.col("e.x").alias("x"), "size")
    vectors = cut_lineage(vectors)
    queries = vectors.filter("id % 20 = 0")
    best = nearest(vectors, queries, vectors.count(), queries.count(), 3)
    top = Window.partitionBy("q").orderBy(F.desc("rank_sim"), "d")
    return best.withColumn("r", F.row_number().over(top)).filter("r <= 3").select("q", "d", F.round("sim", 5).alias("sim"))


_RULES = [("small", "tiny&&mini", "PROMO", "B", "partial", "S", "S"), ("ring", "band", "PROMO", "U", "partial", "S", None), ("bolt", "BOLT", "SMALL", "B", "build", "S", "S"), ("red widget", "crimson widget", "PROMO", "U", "exact", "S", "S")]
_COLUMNS = "alias_1 string, alias_2 string, category string, direction string, type string, case_1 string, case_2 string"


def rules(t: Tables) -> DataFrame:
    return A.explode_rules(t.spark.createDataFrame(_RULES, _COLUMNS))


@query("SELECT DISTINCT 'bolt' AS alias_1, p_name AS alias_2 FROM part WHERE p_type = 'SMALL' AND contains(p_name, 'bolt')")
def q_alias_build(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_name").alias("item_nm"), F.col("p_type").alias("domain"))
    return A.build_rules(items, rules(t))


@query("SELECT * FROM (VALUES ('small', 'tiny'), ('small', 'mini'), ('tiny', 'small'), ('mini', 'small'), ('ring', 'band'), ('bolt', 'BOLT'), ('BOLT', 'bolt'), ('red widget', 'crimson widget')) v(alias_1, alias_2)")
def q_alias_bidirectional(t: Tables) -> DataFrame:
    return A.both_ways(rules(t)).select("alias_1", "alias_2")


@query("""WITH n AS (SELECT DISTINCT p_name AS s FROM part), a AS (SELECT s, s AS x FROM n UNION SELECT s, replace(s, 'small', 'tiny') FROM n UNION SELECT s, replace(s, 'small', 'mini') FROM n), b AS (SELECT * FROM a UNION SELECT s, replace(x, 'ring', 'band') FROM a),
c AS (SELECT * FROM b UNION SELECT s, 'crimson widget' FROM b WHERE x = 'red widget') SELECT s AS item_nm, x AS item_nm_alias FROM c""")
def q_alias_cascade(t: Tables) -> DataFrame:
    return A.cascade(names(t).withColumnRenamed("p_name", "item_nm"), rules(t).filter("type <> 'build'"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN coalesce(n.n_name, '#') ELSE '#' END AS store_nm, CASE WHEN o_orderpriority = '1-URGENT' AND n.n_name IS NOT NULL THEN 'org' ELSE 'product' END AS offer_type FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON c_nationkey = n_nationkey""")
def q_channel_offer(t: Tables) -> DataFrame:
    store = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(store, "c_nationkey", "left")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return j.select("o_orderkey", F.when(urgent, F.coalesce("n_name", F.lit("#"))).otherwise("#").alias("store_nm"), F.when(urgent & F.col("n_name").isNotNull(), "org").otherwise("product").alias("offer_type"))


_GOLD = "(SELECT user_id AS k, CAST(hour(ts) AS VARCHAR) AS e FROM events WHERE event_type = 'view' GROUP BY ALL)"
_PRED = "(SELECT user_id AS k, CAST(hour(ts) AS VARCHAR) AS e FROM events WHERE event_type = 'click' GROUP BY ALL)"


@query(f"""WITH g AS (SELECT k, count(*) AS ng FROM {_GOLD} GROUP BY 1), p AS (SELECT k, count(*) AS np FROM {_PRED} GROUP BY 1), h AS (SELECT k, count(*) AS hit FROM {_GOLD} JOIN {_PRED} USING (k, e) GROUP BY 1),
x AS (SELECT k, ng, coalesce(np, 0) AS np, coalesce(hit, 0) AS hit FROM g LEFT JOIN p USING (k) LEFT JOIN h USING (k))
SELECT count(*) AS n, round(sum(hit) / sum(np), 6)::DOUBLE AS micro_p, round(sum(hit) / sum(ng), 6)::DOUBLE AS micro_r, round(avg(CASE WHEN np = 0 THEN 0 ELSE hit * 1.0 / np END), 6)::DOUBLE AS macro_p, round(avg(hit * 1.0 / ng), 6)::DOUBLE AS macro_r FROM x""")
def q_set_prf_micro_macro(t: Tables) -> DataFrame:
    """Records without gold entries are left out."""
    sets = lambda kind: t.events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("k"), F.hour("ts").alias("e")).distinct()
    gold, pred = sets("view"), sets("click")
    n = lambda d, c: d.groupBy("k").agg(F.count(F.lit(1)).alias(c))
    x = n(gold, "ng").join(n(pred, "np"), "k", "left").join(n(gold.join(pred, ["k", "e"]), "hit"), "k", "left").fillna(0)
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("hit") / F.sum("np"), 6).alias("micro_p"), F.round(F.sum("hit") / F.sum("ng"), 6).alias("micro_r"), F.round(F.avg(F.when(F.col("np") == 0, 0.0).otherwise(F.col("hit") / F.col("np"))), 6).alias("macro_p"), F.round(F.avg(F.col("hit") / F.col("ng")), 6).alias("macro_r"))


@query("""WITH s AS (SELECT user_id, event_type AS m, avg(value) AS v FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2), p AS (SELECT a.user_id, 1 - abs(a.v - b.v) / greatest(a.v, b.v) AS sim FROM s a JOIN s b ON a.user_id = b.user_id AND a.m < b.m)
SELECT user_id, count(*) AS n_pairs, round(avg(sim), 6) AS agreement FROM p GROUP BY 1 HAVING count(*) = 3 AND avg(sim) >= 0.6""")
def q_consensus_pairs(t: Tables) -> DataFrame:
    """Records on which all three models answered and agree on average."""
    s = t.events.filter(F.col("event_type").isin("view", "click", "error")).groupBy("user_id", F.col("event_type").alias("m")).agg(F.avg("value").alias("v"))
    b = s.select("user_id", F.col("m").alias("m2"), F.col("v").alias("v2"))
    p = s.join(b, "user_id").filter("m < m2").select("user_id", (1 - F.abs(F.col("v") - F.col("v2")) / F.greatest("v", "v2")).alias("sim"))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("sim").alias("agreement")).filter("n_pairs = 3 and agreement >= 0.6").withColumn("agreement", F.round("agreement", 6))


@query("SELECT CASE WHEN c_acctbal >= 9000 THEN 'A' WHEN c_acctbal >= 7000 THEN 'B' WHEN c_acctbal >= 5000 THEN 'C' ELSE 'D' END AS grade, count(*) AS n FROM customer GROUP BY 1")
def q_grade_bands(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    return t.customer.groupBy(F.when(b >= 9000, "A").when(b >= 7000, "B").when(b >= 5000, "C").otherwise("D").alias("grade")).agg(F.count(F.lit(1)).alias("n"))
