"""Cleaning, tokenizing and parsing of messages, pages and structured answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.plans.registry import Tables, query

_WS = r"[ \t\n\r\f\x0B]"


@query(rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_ \t\n\r\f\x0B]', ' ', 'g'), '{_WS}+', ' ', 'g'))) AS h FROM documents""")
def q_preprocess_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.preprocess(F.col("text"))).alias("h"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '[^a-zA-Z0-9가-힣 \t\n\r\f\x0B]', ' ', 'g')) AS h FROM documents""")
def q_replace_special(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.keep_basic(F.col("text"))).alias("h"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '\n[ \t\n]*\n', chr(10) || chr(10), 'g')) AS h FROM documents""")
def q_clean_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.clean(F.col("text"))).alias("h"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'https?://[^ \t\n"<>]+', '', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g')) AS h FROM documents""")
def q_strip_urls_emails(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.strip_links(F.col("text"))).alias("h"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')  x', '\([^)]*\)', ' ', 'g'), ' +', ' ', 'g')) AS name FROM part""")
def q_normalize_entity(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.normalize_entity(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")  x"))).alias("name"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS head, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), url) AS title FROM pages""")
def q_regex_extract(t: Tables) -> DataFrame:
    got = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t.pages.select("page_id", got("<h1>([^<]*)</h1>").alias("head"), F.coalesce(got("<title>([^<]*)</title>"), F.col("url")).alias("title"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}'), ',') AS phones FROM documents WHERE regexp_matches(text, '[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}')""")
def q_phone_numbers(t: Tables) -> DataFrame:
    p = r"[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}"
    return t.documents.filter(F.col("text").rlike(p)).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(0)), ",").alias("phones"))


@query(f"""WITH s AS (SELECT doc_id, trim(s) AS s, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
x AS (SELECT doc_id, s, i, CASE WHEN length(s) BETWEEN 10 AND 100 THEN 10 WHEN length(s) > 150 THEN -10 ELSE 0 END + {' + '.join(f"CASE WHEN contains(lower(s), '{k}') THEN 5 ELSE 0 END" for k in X.TITLE_KEYWORDS)} AS score FROM s WHERE length(s) > 5)
SELECT doc_id, CASE WHEN length(s) > 100 THEN substr(s, 1, 100) || '...' ELSE s END AS title, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM x) WHERE r = 1""")
def q_title_heuristic(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s")).withColumn("s", F.trim("s")).filter(F.length("s") > 5)
    score = F.when(F.length("s").between(10, 100), 10).when(F.length("s") > 150, -10).otherwise(0)
    for k in X.TITLE_KEYWORDS:
        score = score + F.when(F.contains(F.lower("s"), F.lit(k)), 5).otherwise(0)
    best = s.withColumn("score", score).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("i")).alias("i"), "s")).alias("b"))
    cut = F.when(F.length("b.s") > 100, F.concat(F.substring("b.s", 1, 100), F.lit("..."))).otherwise(F.col("b.s"))
    return best.select("doc_id", cut.alias("title"), F.col("b.score").alias("score"))


@query("""WITH s AS (SELECT DISTINCT p_brand, s FROM (SELECT p_brand, unnest(list_concat(string_split(p_name, ' '), [p_name])) AS s FROM part)) SELECT p_brand, string_agg(s, ',' ORDER BY s) AS names FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.p_brand = b.p_brand AND a.s <> b.s AND contains(b.s, a.s)) GROUP BY 1""")
def q_maximal_strings(t: Tables) -> DataFrame:
    a = t.part.groupBy("p_brand").agg(F.array_distinct(F.flatten(F.collect_set(F.concat(F.split("p_name", " "), F.array("p_name"))))).alias("a"))
    return a.select("p_brand", F.array_join(F.array_sort(X.maximal_strings(F.col("a"))), ",").alias("names"))


@query(r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[^ \n]+') AS w FROM benchmark), g AS (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM w, range(2, 4) r(n) WHERE len(w) >= n)
SELECT item_id, array_to_string(w[i + 1 : i + n], ' ') AS gram, CAST(i AS INTEGER) AS start, CAST(i + n AS INTEGER) AS "end" FROM g""")
def q_word_ngrams(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)).alias("w"))
    return words.select("item_id", F.inline(X.word_ngrams(F.col("w"), 2, 3)))


@query("""SELECT p_name, string_agg(DISTINCT substr(s, CAST(i AS INTEGER), 2), ',' ORDER BY substr(s, CAST(i AS INTEGER), 2)) AS grams FROM (SELECT DISTINCT p_name, lower(regexp_replace(p_name, '[^가-힣a-zA-Z0-9]', '', 'g')) AS s FROM part), unnest(range(1, greatest(length(s), 2))) r(i) GROUP BY 1""")
def q_char_bigrams(t: Tables) -> DataFrame:
    return t.part.select("p_name").distinct().select("p_name", F.array_join(F.array_sort(X.bigrams(F.col("p_name"))), ",").alias("grams"))


@query(r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(text), '[가-힣]+|[a-z0-9]+')) AS INTEGER) AS n, regexp_extract(lower(text), '[가-힣]+|[a-z0-9]+') AS first FROM conversations""")
def q_tokenize(t: Tables) -> DataFrame:
    p = "[가-힣]+|[a-z0-9]+"
    return t.conversations.select("conv_id", "turn", F.size(F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0))).alias("n"), F.regexp_extract(F.lower("text"), p, 0).alias("first"))


_STOP = ("the", "and", "der", "die", "las", "les")


@query(rf"""SELECT w AS keyword, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations) WHERE length(w) BETWEEN 3 AND 20 AND w NOT IN {_STOP} GROUP BY 1 HAVING count(*) >= 5""")
def q_keyword_freq(t: Tables) -> DataFrame:
    w = t.conversations.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("keyword"))
    w = w.filter(F.length("keyword").between(3, 20) & ~F.col("keyword").isin(*_STOP))
    return w.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query(r"""SELECT conv_id, turn, CASE WHEN contains(c, 'that') THEN 'view' WHEN contains(c, 'with') OR contains(c, 'für') THEN 'join' ELSE 'other' END AS action FROM (SELECT conv_id, turn, substr(lower(text), greatest(1, instr(lower(text), ' the ') - 40), 80) AS c FROM conversations WHERE instr(lower(text), ' the ') > 0)""")
def q_action_from_context(t: Tables) -> DataFrame:
    at = F.instr(F.lower("text"), " the ")
    c = t.conversations.filter(at > 0).select("conv_id", "turn", F.substring(F.lower("text"), F.greatest(F.lit(1), at - 40), F.lit(80)).alias("c"))
    action = F.when(F.contains("c", F.lit("that")), "view").when(F.contains("c", F.lit("with")) | F.contains("c", F.lit("für")), "join").otherwise("other")
    return c.select("conv_id", "turn", action.alias("action"))


_HTML = "html"
for _p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
    _HTML = f"regexp_replace({_HTML}, '{_p}', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_e}', '{_c}')"


@query(f"SELECT page_id, md5(trim(regexp_replace({_HTML}, '{_WS}+', ' ', 'g'))) AS h FROM pages")
def q_html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("h"))


@query(r"""SELECT page_id, i AS link_no, regexp_extract(a, 'href="([^"]*)"', 1) AS href, substr(regexp_extract(a, '>([^<]*)</a>', 1), 1, 100) AS name FROM (SELECT page_id, unnest(x) AS a, CAST(generate_subscripts(x, 1) AS INTEGER) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>[^<]*</a>') AS x FROM pages)) WHERE contains(lower(a), 'th')""")
def q_link_filter(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<a [^>]*>[^<]*</a>"), F.lit(0))).alias("i", "a"))
    return links.filter(F.contains(F.lower("a"), F.lit("th"))).select("page_id", (F.col("i") + 1).alias("link_no"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.substring(F.regexp_extract("a", ">([^<]*)</a>", 1), 1, 100).alias("name"))


@query(r"""SELECT page_id, substr(regexp_replace(replace(regexp_replace(regexp_replace(url, '^https?://(www\.)?', ''), '[?#].*$', ''), '/', '_'), '[^A-Za-z0-9._-]', '', 'g'), 1, 100) AS name FROM pages""")
def q_url_to_name(t: Tables) -> DataFrame:
    u = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.)?", ""), "[?#].*$", "")
    return t.pages.select("page_id", F.substring(F.regexp_replace(F.replace(u, F.lit("/"), F.lit("_")), "[^A-Za-z0-9._-]", ""), 1, 100).alias("name"))


@query(r"""SELECT page_id, CASE WHEN instr(html, '<article>') > 0 AND instr(substr(html, instr(html, '<article>') + 9), '</article>') > 0 THEN md5(substr(html, instr(html, '<article>') + 9, instr(substr(html, instr(html, '<article>') + 9), '</article>') - 1)) END AS h FROM pages""")
def q_extract_between(t: Tables) -> DataFrame:
    rest = F.expr("substring(html, instr(html, '<article>') + 9)")
    inner = F.expr("substring(substring(html, instr(html, '<article>') + 9), 1, instr(substring(html, instr(html, '<article>') + 9), '</article>') - 1)")
    return t.pages.select("page_id", F.when((F.instr("html", "<article>") > 0) & (F.instr(rest, "</article>") > 0), F.md5(inner)).alias("h"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_json_extract(t: Tables) -> DataFrame:
    fixed = F.when(F.get_json_object("props", "$.k").isNotNull(), F.col("props"))
    return t.events.select("event_id", F.from_json(fixed, "k int")["k"].alias("k"))


@query()
def q_json_repair(t: Tables) -> DataFrame:
    broken = F.concat(F.lit("answer: {name: '"), "p_name", F.lit("', \"size\": "), "p_size", F.lit(",, }"))
    return t.part.select("p_partkey", X.repair_json_udf(broken).alias("j")).select("p_partkey", F.from_json("j", "name string, size int").alias("s")).select("p_partkey", "s.name", "s.size")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k, '#' AS title, json_extract(props, '$.k') IS NOT NULL AS valid FROM events")
def q_validate_result(t: Tables) -> DataFrame:
    p = F.from_json("props", "k int, title string", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", p.alias("p")).select("event_id", F.coalesce("p.k", F.lit(0)).alias("k"), F.coalesce("p.title", F.lit("#")).alias("title"), F.col("p.k").isNotNull().alias("valid"))


@query("SELECT p_partkey, p_name || ';' || p_brand AS entities FROM part")
def q_parse_pipe_list(t: Tables) -> DataFrame:
    line = F.concat(F.lit("thought\nENTITY: "), "p_name", F.lit(" | "), "p_brand", F.lit(" | none |"))
    return t.part.select("p_partkey", F.array_join(X.parse_entity_line(line), ";").alias("entities"))


@query()
def q_chunk_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.chunk_udf(1000, 100)("text")).alias("chunk_no", "chunk"))


@query()
def q_span_resolution(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)).alias("w")).select("item_id", F.inline(X.word_ngrams(F.col("w"), 1, 3)))
    spans = words.select("item_id", "start", "end", F.length("gram").alias("score"), F.lower(F.substring("gram", 1, 2)).alias("entity"))

    @F.pandas_udf("array<struct<start:int,end:int,score:int,entity:string>>")
    def resolve(s: pd.Series) -> pd.Series:
        return s.map(lambda a: X.resolve_spans([dict(x) if isinstance(x, dict) else x.asDict() for x in a]))

    return spans.groupBy("item_id").agg(F.collect_list(F.struct("start", "end", "score", "entity")).alias("a")).select("item_id", F.inline(resolve("a")))


@query("""SELECT p_name AS item_nm, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS item_ids, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS names, coalesce(string_agg(DISTINCT nullif(p_type, 'PROMO'), ',' ORDER BY nullif(p_type, 'PROMO')), '') AS actions FROM part GROUP BY 1""")
def q_item_centric(t: Tables) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return t.part.groupBy(F.col("p_name").alias("item_nm")).agg(joined(F.col("p_partkey").cast("string")).alias("item_ids"), joined(F.col("p_brand")).alias("names"), joined(F.nullif("p_type", F.lit("PROMO"))).alias("actions"))


@query("SELECT o_custkey, " + ", ".join(f"coalesce(max(CASE WHEN r = {k} THEN CAST(o_orderkey AS VARCHAR) END), '') AS item_{k}" for k in range(1, 6)) + " FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def q_flatten_top5(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 5).alias("a"))
    return a.select("o_custkey", *[F.coalesce(F.get("a", F.lit(k - 1)).cast("string"), F.lit("")).alias(f"item_{k}") for k in range(1, 6)])


@query("SELECT o_orderkey, o_custkey, coalesce(m.seq, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders LEFT JOIN (SELECT user_id, count(*) AS seq FROM events GROUP BY 1) m ON user_id = o_custkey")
def q_versioned_insert(t: Tables) -> DataFrame:
    have = t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(F.count(F.lit(1)).alias("have"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(have, "o_custkey", "left").select("o_orderkey", "o_custkey", (F.coalesce("have", F.lit(0)) + nth).alias("seq"))
