"""Page records, the product match cascade, seeded samples and splits, and queries over whole tables."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import similarity as S
from tidemark.functions import text as X
from tidemark.functions.pages import capture
from tidemark.operators import aliases as A
from tidemark.operators import pipelines as P
from tidemark.operators import samples
from tidemark.operators.allocation import cut_lineage, global_rank
from tidemark.operators.blocking import candidates
from tidemark.operators.matching import best_aliases, items_of, one_to_one_pairs
from tidemark.plans.learning import rows
from tidemark.plans.registry import Tables, query
from tidemark.sources.files import latest, normalized

# pages


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title, len(regexp_extract_all(html, '<a href="[^"]+"')) AS n_links, array_to_string(regexp_extract_all(html, '<a href="([^"]+)"', 1), ' ') AS hrefs, 0 AS n_images FROM pages""")
def q_page_capture(t: Tables) -> DataFrame:
    p = t.pages.withColumn("page", capture(F.col("html")))
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select("page_id", raw.alias("raw_title"), F.size("page.links").cast("long").alias("n_links"), F.array_join(F.transform("page.links", lambda x: x["href"]), " ").alias("hrefs"), F.size("page.images").alias("n_images"))


# product matches

_ENTITIES = "(SELECT DISTINCT p_name AS entity FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part)"
_ALIASES = "(SELECT name AS alias, name AS item_nm, item_id, kind AS item_dmn FROM items WHERE name IS NOT NULL UNION ALL SELECT split_part(name, ' ', 2), name, item_id, kind FROM items WHERE name IS NOT NULL)"
_BIGRAMS = "SELECT {k}, unnest(list_distinct([substr(s, CAST(i AS INTEGER), 2) FOR i IN range(1, greatest(length(s), 2))])) AS g FROM (SELECT DISTINCT {k}, lower(regexp_replace({k}, '[^가-힣a-zA-Z0-9]', '', 'g')) AS s FROM {t})"
_EG, _AG = _BIGRAMS.format(k="entity", t=_ENTITIES), _BIGRAMS.format(k="alias", t=_ALIASES)
_MATCH = f"""WITH eg AS ({_EG}), ag AS ({_AG}), en AS (SELECT entity, count(*) AS n FROM eg GROUP BY 1), an AS (SELECT alias, count(*) AS n FROM ag GROUP BY 1),
p AS (SELECT entity, alias, round(count(*) * 1.0 / (any_value(en.n) + any_value(an.n) - count(*)), 6)::DOUBLE AS score FROM eg JOIN ag USING (g) JOIN en USING (entity) JOIN an USING (alias) GROUP BY 1, 2),
a AS (SELECT *, alias = entity AS same, contains(alias, entity) OR contains(entity, alias) AS inside, length(alias) * 1.0 / length(entity) AS ratio FROM p),
b AS (SELECT *, CASE WHEN max(CAST(same AS INTEGER)) OVER w = 1 THEN 1 WHEN max(CAST(inside AS INTEGER)) OVER w = 1 THEN 2 ELSE 3 END AS tier, inside AND ratio >= 0.7 * max(CASE WHEN inside THEN ratio END) OVER w AS long FROM a WINDOW w AS (PARTITION BY entity)),
c AS (SELECT *, CASE tier WHEN 1 THEN same WHEN 2 THEN long AND score >= 0.9 * max(CASE WHEN long THEN score END) OVER w ELSE score >= greatest(0.4, 0.85 * max(score) OVER w) END AS ok FROM b WINDOW w AS (PARTITION BY entity)),
d AS (SELECT *, max(CAST(ok AS INTEGER)) OVER (PARTITION BY entity) AS n_ok, row_number() OVER (PARTITION BY entity, ok ORDER BY score DESC, alias) AS n, row_number() OVER (PARTITION BY entity ORDER BY score DESC, alias) AS k FROM c),
m AS (SELECT entity, alias, score, CASE WHEN n_ok = 0 THEN 'few' WHEN tier = 1 THEN 'same' WHEN tier = 2 THEN 'contained' ELSE 'similar' END AS tier FROM d WHERE (n_ok = 1 AND ok AND n <= 5) OR (n_ok = 0 AND k <= 3))"""


def _scored(t: Tables) -> DataFrame:
    """Entities from part names (whole, their first words, and turned round) against all aliases that share a bigram."""
    part = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    e = t.part.select(F.explode(F.array(F.col("p_name"), part(1), F.concat(part(2), F.lit(" "), part(1)))).alias("entity")).distinct()
    a = _aliases(t).select("alias").distinct()
    c = candidates(e, "entity", X.bigrams(F.col("entity")), a, "alias", X.bigrams(F.col("alias")))
    return c.select("entity", "alias", F.round(S.jaccard(X.bigrams(F.col("entity")), X.bigrams(F.col("alias"))), 6).alias("score"))


def _aliases(t: Tables) -> DataFrame:
    """Items under their own names, and under their last words, which many share."""
    i = t.items.filter("name is not null")
    own, last = F.col("name"), F.split_part("name", F.lit(" "), F.lit(2))
    return i.select(F.explode(F.array(own, last)).alias("alias"), F.col("name").alias("item_nm"), "item_id", F.col("kind").alias("item_dmn"))


@query(_MATCH + " SELECT * FROM m")
def q_product_aliases(t: Tables) -> DataFrame:
    return best_aliases(_scored(t), 0.4)


@query(_MATCH + f""", j AS (SELECT DISTINCT m.*, item_nm, item_id, item_dmn FROM m JOIN {_ALIASES} USING (alias)), q AS (SELECT *, item_nm = entity AS direct, max(CAST(item_nm = entity AS INTEGER)) OVER (PARTITION BY entity, alias) AS n_direct FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, item_nm, item_id ORDER BY score DESC, alias) AS n FROM q WHERE direct OR n_direct = 0) SELECT entity, alias, score, tier, item_nm, item_id, item_dmn FROM r WHERE n = 1""")
def q_product_items(t: Tables) -> DataFrame:
    """Items of each entity; the entity's own name is what the alias rules reach here."""
    scored = _scored(t)
    reached = scored.select("entity", F.col("entity").alias("name")).distinct()
    return items_of(best_aliases(scored, 0.4), _aliases(t), reached)


@query()
def q_greedy_pairs(t: Tables) -> DataFrame:
    """Entities and aliases paired one to one by falling score, over all of them."""
    return one_to_one_pairs(_scored(t), "entity", "alias", least=0.3)


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 10 ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 25")
def q_latest_errors(t: Tables) -> DataFrame:
    """The latest errors above a value, as a document store would find them."""
    return latest(t.events, "ts", 25, (F.col("event_type") == "error") & (F.col("value") > 10), "event_id").select("event_id", "user_id", "value")


_HOURS = "(SELECT user_id, event_type AS m, list_sort(list_distinct(list(hour(ts)))) AS hs, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') AND user_id IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH s AS {_HOURS}, g AS (SELECT user_id FROM s GROUP BY 1 HAVING count(*) = 3 AND sum(n) >= 40),
p AS (SELECT a.user_id, len(list_intersect(a.hs, b.hs)) * 1.0 / len(list_distinct(list_concat(a.hs, b.hs))) AS j FROM s a JOIN s b ON a.user_id = b.user_id AND a.m < b.m)
SELECT user_id, round(avg(j), 6)::DOUBLE AS agreement, CASE WHEN avg(j) >= 0.7 THEN 'A' WHEN avg(j) >= 0.5 THEN 'B' ELSE 'C' END AS grade FROM p JOIN g USING (user_id) GROUP BY 1 HAVING avg(j) >= 0.4""")
def q_consensus_truth(t: Tables) -> DataFrame:
    """Records on which all three sources gave an answer, of enough length, and agree on average; with a grade.

    A record's three answers meet in one row of one aggregation, so there is no self-join.
    """
    kinds = ("click", "purchase", "view")  # in the order of their names, as the SQL pairs them: rounding decides at the bound of a grade
    e = t.events.filter(F.col("event_type").isin(*kinds) & F.col("user_id").isNotNull()).withColumn("h", F.hour("ts"))
    sets = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.collect_set(F.when(F.col("event_type") == k, F.col("h"))).alias(k) for k in kinds])
    whole = sets.filter((F.col("n") >= 40) & (F.size("view") > 0) & (F.size("click") > 0) & (F.size("purchase") > 0))
    pairs = [S.jaccard(F.col(a), F.col(b)) for i, a in enumerate(kinds) for b in kinds[i + 1 :]]
    mean = whole.select("user_id", (sum(pairs[1:], pairs[0]) / len(pairs)).alias("j")).filter("j >= 0.4")
    return mean.select("user_id", F.round("j", 6).alias("agreement"), F.when(F.col("j") >= 0.7, "A").when(F.col("j") >= 0.5, "B").otherwise("C").alias("grade"))


@query()
def q_sampled_pipelines(t: Tables) -> DataFrame:
    """Two feature pipelines fitted on seeded samples, the second on what the first gives, then applied to all rows.

    The click model's features and probability are inputs of the gap model; both probabilities come out.
    """
    df = rows(t).withColumn("fast", (F.col("utility") > 50).cast("int"))
    sample = lambda d, seed: samples.hash_sample(d, "user_id", 0.5, seed)
    inputs = df.select("last_cd", "traffic_amt", "event_cnt")
    first = P.feature_pipeline(inputs, scale=False).fit(sample(df, 1))
    clicked = first.transform(df)
    click = P.score(P.classifier("gbt", "label", iterations=3, depth=2).fit(first.transform(sample(df, 1))), clicked, "prob_click")
    again = cut_lineage(click.select("user_id", "send_hour", "fast", "last_cd", "traffic_amt", "event_cnt", "prob_click").withColumn("prob_click_score", F.col("prob_click").cast("float")))
    second = P.feature_pipeline(again.select("last_cd", "traffic_amt", "event_cnt", "prob_click_score"), scale=False).fit(sample(again, 2))
    gap = P.score(P.classifier("gbt", "fast", iterations=3, depth=2).fit(second.transform(sample(again, 2))), second.transform(again), "prob_gap")
    return gap.select("user_id", "send_hour", F.round("prob_click", 4).alias("prob_click"), F.round("prob_gap", 4).alias("prob_gap"), F.round(F.col("prob_click") * F.col("prob_gap"), 4).alias("propensity_score"))


_RULE = "(SELECT DISTINCT name, brand, size % 2 = 0 AS two_way FROM items WHERE name IS NOT NULL AND brand IS NOT NULL AND size IS NOT NULL)"
_SPLIT = f"(SELECT unnest([name, upper(name)]) AS alias_1, brand AS alias_2, 'S' AS case_1, 'I' AS case_2, two_way FROM {_RULE})"


@query(f"SELECT DISTINCT alias_1, alias_2, case_1, case_2 FROM (SELECT alias_1, alias_2, case_1, case_2 FROM {_SPLIT} UNION ALL SELECT alias_2, alias_1, case_2, case_1 FROM {_SPLIT} WHERE two_way)")
def q_alias_rules(t: Tables) -> DataFrame:
    """Rules from all items: alternatives are split, missing case marks filled, and rules of direction B swapped with their marks."""
    i = t.items.filter("name is not null and brand is not null and size is not null")
    rules = i.select(
        F.concat_ws("&&", F.col("name"), F.upper("name")).alias("alias_1"), F.col("brand").alias("alias_2"),
        F.lit(None).cast("string").alias("case_1"), F.lit("I").alias("case_2"), F.when(F.col("size") % 2 == 0, "B").otherwise("U").alias("direction"),
    )
    return A.both_ways(A.explode_rules(rules.distinct())).select("alias_1", "alias_2", "case_1", "case_2").distinct()


@query("SELECT user_id, count(*) AS n_rows, count(DISTINCT (event_type, hour(ts))) AS n_records, string_agg(DISTINCT event_type || ':' || CAST(hour(ts) AS VARCHAR), ',' ORDER BY event_type || ':' || CAST(hour(ts) AS VARCHAR)) AS records FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def q_dedup_records(t: Tables) -> DataFrame:
    """Each user's list of records without its repeats."""
    record = F.struct("event_type", F.hour("ts").alias("h"))
    g = t.events.filter("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.collect_set(record).alias("r"))
    named = F.array_sort(F.transform("r", lambda x: F.concat_ws(":", x["event_type"], x["h"].cast("string"))))
    return g.select("user_id", "n_rows", F.size("r").cast("long").alias("n_records"), F.array_join(named, ",").alias("records"))


@query("SELECT vendor_id, name, 'N' AS del_yn, coalesce(CAST(nation_id AS VARCHAR), 'none') AS nation FROM vendors")
def q_normalized_columns(t: Tables) -> DataFrame:
    """Columns in other cases and with blanks, lower-cased, with a default column added."""
    odd = t.vendors.select(F.col("vendor_id").alias("VENDOR_ID "), F.col("name").alias("Name"), F.col("nation_id").alias("Nation_ID"))
    df = normalized(odd, {"del_yn": F.lit("N"), "name": F.lit("never")})
    return df.select("vendor_id", "name", "del_yn", F.coalesce(F.col("nation_id").cast("string"), F.lit("none")).alias("nation"))


# samples and splits

_HASH = "substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)"


@query(f"SELECT o_orderkey, part FROM (SELECT o_orderkey, CASE WHEN {_HASH.format(seed=11, key='o_orderkey')} < '{samples.below(0.8)}' THEN 'train' ELSE 'test' END AS part FROM orders)")
def q_seeded_split(t: Tables) -> DataFrame:
    return samples.seeded_split(t.orders.select("o_orderkey"), "o_orderkey", 0.8, 11)


@query(f"SELECT o_orderkey, CAST(CAST('0x' || {_HASH.format(seed=5, key='o_orderkey')} AS BIGINT) % 5 AS INTEGER) AS fold FROM orders")
def q_hash_folds(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", samples.fold_of(F.col("o_orderkey"), 5, 5).alias("fold"))


@query(f"SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY {_HASH.format(seed=3, key='event_id')}, event_id LIMIT 100")
def q_unprocessed_sample(t: Tables) -> DataFrame:
    """A hundred events that have not been worked on."""
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return samples.unprocessed_sample(t.events.select("event_id"), done, "event_id", 100, 3)


@query(f"""WITH r AS (SELECT item_id, row_number() OVER (ORDER BY {_HASH.format(seed=2, key='item_id')}, item_id) - 1 AS i, count(*) OVER () AS n FROM items), a AS (SELECT item_id, i, i % (n // 10) = 0 AND i // (n // 10) < 10 AS anchor FROM r)
SELECT item_id, anchor, CASE WHEN anchor THEN NULL ELSE (row_number() OVER (PARTITION BY anchor ORDER BY i) - 1) // 25 END AS batch FROM a""")
def q_anchor_batches(t: Tables) -> DataFrame:
    """Items in seeded order: ten evenly spaced anchors, the others in batches of 25."""
    i = t.items.select("item_id", samples.hash_part(F.col("item_id"), 2).alias("h"))
    n = i.count()
    ranked = global_rank(i, [F.asc("h"), F.asc("item_id")], "i").select("item_id", (F.col("i") - 1).alias("i"))
    step = max(1, n // 10)
    anchor = (F.col("i") % step == 0) & (F.floor(F.col("i") / step) < 10)
    # of the places before i, those of anchors are known without counting
    before = F.least(F.floor((F.col("i") + step - 1) / step), F.lit(10))
    return ranked.select("item_id", anchor.alias("anchor"), F.when(~anchor, F.floor((F.col("i") - before) / 25)).alias("batch"))


# whole tables, and rows where earlier queries had none


@query("SELECT i.item_id, coalesce(CAST(max(sale_id) AS VARCHAR), '#') AS last_sale, CASE WHEN max(sale_id) IS NULL THEN 'other' ELSE 'buy' END AS action FROM items i LEFT JOIN sale_lines l ON l.item_id = i.item_id GROUP BY 1")
def q_no_sale_fallback(t: Tables) -> DataFrame:
    """Items without any sale get '#' and the default action."""
    last = t.sale_lines.groupBy("item_id").agg(F.max("sale_id").alias("k"))
    j = t.items.select("item_id").join(last, "item_id", "left")
    return j.select("item_id", F.coalesce(F.col("k").cast("string"), F.lit("#")).alias("last_sale"), F.when(F.col("k").isNull(), "other").otherwise("buy").alias("action"))


@query("""SELECT user_id, n_view, n_purchase, n_error FROM (SELECT user_id, count(*) AS n_view FROM events WHERE event_type = 'view' GROUP BY 1) FULL JOIN (SELECT user_id, count(*) AS n_purchase FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id)
FULL JOIN (SELECT user_id, count(*) AS n_error FROM events WHERE event_type = 'error' GROUP BY 1) USING (user_id)""")
def q_outer_merge_types(t: Tables) -> DataFrame:
    """Counts of three event types by user, merged by an outer join."""
    n = lambda kind: t.events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias(f"n_{kind}"))
    return n("view").join(n("purchase"), "user_id", "full").join(n("error"), "user_id", "full")


@query("""SELECT s.sale_id, CASE WHEN s.status = 'done' THEN coalesce(v.store, '#') ELSE '#' END AS store_nm, CASE WHEN s.status = 'done' AND v.store IS NOT NULL THEN 'org' ELSE 'product' END AS offer_type
FROM sales s LEFT JOIN (SELECT DISTINCT client_id, nation_id FROM clients) c USING (client_id) LEFT JOIN (SELECT nation_id, min(name) AS store FROM vendors WHERE nation_id IS NOT NULL GROUP BY 1) v USING (nation_id)""")
def q_store_offer(t: Tables) -> DataFrame:
    """All sales; those that are done name the first vendor of the client's nation, where it has one."""
    store = t.vendors.filter("nation_id is not null").groupBy("nation_id").agg(F.min("name").alias("store"))
    j = t.sales.join(t.clients.select("client_id", "nation_id").distinct(), "client_id", "left").join(store, "nation_id", "left")
    done = F.coalesce(F.col("status") == "done", F.lit(False))
    return j.select("sale_id", F.when(done, F.coalesce("store", F.lit("#"))).otherwise("#").alias("store_nm"), F.when(done & F.col("store").isNotNull(), "org").otherwise("product").alias("offer_type"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"user\", CAST(h AS INTEGER) AS \"hour\", round(least(0.99, greatest(0.1, 0.9 - 0.08 * abs(h - (9 + (c_custkey * 7) % 10)) + ((c_custkey * 31 + h * 17) % 11) / 100.0)), 6)::DOUBLE AS score FROM customer, range(9, 19) r(h)")
def q_customer_scores(t: Tables) -> DataFrame:
    """A grid of all customers and ten hours; the score falls with the distance from the customer's own hour."""
    grid = t.customer.select(F.col("c_custkey").alias("id"), F.explode(F.sequence(F.lit(9), F.lit(18))).alias("hour"))
    raw = 0.9 - 0.08 * F.abs(F.col("hour") - (9 + F.col("id") * 7 % 10)) + (F.col("id") * 31 + F.col("hour") * 17) % 11 / 100
    return grid.select(F.col("id").cast("string").alias("user"), "hour", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.1), raw)), 6).alias("score"))


_BOTH = "(SELECT DISTINCT name AS alias_1, brand AS alias_2, CASE WHEN size % 2 = 0 THEN 'B' ELSE 'U' END AS direction FROM items WHERE name IS NOT NULL AND brand IS NOT NULL)"


@query(f"SELECT alias_1, alias_2 FROM {_BOTH} UNION SELECT alias_2, alias_1 FROM {_BOTH} WHERE direction = 'B'")
def q_alias_both_ways(t: Tables) -> DataFrame:
    """Names and brands of all items as alias rules; those of even sizes hold both ways."""
    i = t.items.filter("name is not null and brand is not null and size is not null")
    both = F.array(F.struct(F.col("name").alias("alias_1"), F.col("brand").alias("alias_2")), F.struct(F.col("brand").alias("alias_1"), F.col("name").alias("alias_2")))
    return i.select(F.explode(F.when(F.col("size") % 2 == 0, both).otherwise(F.slice(both, 1, 1))).alias("r")).select("r.*").distinct()


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})|(0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4})'), ',') AS phones FROM documents WHERE regexp_matches(text, '(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})|(0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4})')""")
def q_phones_of_documents(t: Tables) -> DataFrame:
    """Phone numbers with a country code, or as in a message."""
    p = r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})|(0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4})"
    return t.documents.filter(F.col("text").rlike(p)).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(0)), ",").alias("phones"))


@query("""WITH i AS (SELECT w, count(DISTINCT p_name) AS n_names FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1)
SELECT DISTINCT item_id, w AS token, n_names FROM (SELECT item_id, unnest(string_split(name, ' ')) AS w FROM items) JOIN i USING (w)""")
def q_item_index(t: Tables) -> DataFrame:
    """Words of item names in the inverted index of part names."""
    index = t.part.select("p_name").distinct().select(F.explode(F.split("p_name", " ")).alias("token"), "p_name").groupBy("token").agg(F.count_distinct("p_name").alias("n_names"))
    w = t.items.filter("name is not null").select("item_id", F.explode(F.array_distinct(F.split("name", " "))).alias("token"))
    return w.join(index, "token").select("item_id", "token", "n_names")


@query()
def q_hashing_tf_buckets(t: Tables) -> DataFrame:
    """How often each bucket of hashed terms is met in an item's text."""
    words = t.benchmark.filter("text is not null").select("item_id", F.split("text", " ").alias("words"))
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=1024).transform(words)
    each = tf.select("item_id", F.posexplode(vector_to_array("tf")).alias("bucket", "n"))
    return each.filter("n > 0").select("item_id", "bucket", F.col("n").cast("long").alias("n"))


@query("""SELECT client_id, CAST(datediff('month', first, last) - CASE WHEN day(last) < day(first) AND NOT (last = last_day(last)) THEN 1 ELSE 0 END AS BIGINT) AS whole_months FROM
(SELECT client_id, min(CAST(sold_at AS DATE)) AS first, max(CAST(sold_at AS DATE)) AS last FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY 1)""")
def q_months_between(t: Tables) -> DataFrame:
    """Whole months between a client's first and last sale; the last day of a month completes one whatever the first day was."""
    s = t.sales.filter("client_id is not null and sold_at is not null").withColumn("d", F.to_date("sold_at"))
    g = s.groupBy("client_id").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    # months_between takes a month's last day for a whole month only where the first day is one too
    months = 12 * (F.year("last") - F.year("first")) + F.month("last") - F.month("first")
    short = (F.day("last") < F.day("first")) & (F.col("last") != F.last_day("last"))
    return g.select("client_id", (months - short.cast("int")).cast("long").alias("whole_months"))


@query("SELECT coalesce(CAST(conv_id AS VARCHAR), 'row') || '-' || CAST(turn AS VARCHAR) AS message_id, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def q_message_ids(t: Tables) -> DataFrame:
    """Valid messages with an id that falls back to their place."""
    m = t.conversations.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    by = Window.partitionBy("conv_id")
    return m.select(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("row")), F.lit("-"), F.col("turn").cast("string")).alias("message_id"), F.count(F.lit(1)).over(by).alias("n_turns"))
