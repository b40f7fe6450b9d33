"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cohorts, decontamination, filter_audit, language_id, language_model, packing, quality_fm, quality_rules, sharding, simhash, substring_dedup, token_counts, tokens, toxicity
from tidemark.plans.session import ship

from .common import doc_crc, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_separator_scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.document_token_counts(documents(spark, sf_dir), tokens.default_path(), end_id=49407)
    return out.select("doc_id", "n_tokens")


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir), radius=4, words=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_equal")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = doc_crc() % 5 == 0
    return language_id.identify(docs, language_id.fit(docs.filter(~held_out)), held_out)


def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(documents(spark, sf_dir))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(documents(spark, sf_dir), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = doc_crc() % 4 == 2
    machine = quality_fm.fit(quality_fm.labelled_sample(docs, labels, ~held_out))
    return quality_fm.score(docs, machine, held_out).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8, recall=0.99)


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = doc_crc() % 10 == 0
    return language_model.score(docs, held_out)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokens.default_path(), capacity=4096, end_id=1), capacity=4096)


def op11_bitmap_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    clicks, clients = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "clients"))
    late = F.crc32(F.col("click_id").cast("string").cast("binary"))
    arrival = F.when(late % 3 == 0, F.col("arrived_at") + F.make_dt_interval((late % 100).cast("int"))).otherwise(F.col("arrived_at"))
    return cohorts.retention(clicks, clients, arrival, ["2024-02-15 00:00:00", None])


def op12_walsh_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = doc_crc() % 5 == 0
    out = toxicity.score(docs, toxicity.fit(docs, labels, ~held_out), held_out)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    numbered = (
        op1_separator_scan_tokens, op2_quality_cascade, op3_simhash_dedup, op4_language_id, op5_debruijn_dedup, op6_byte_shards, op7_quality_fm,
        op8_cgk_decontamination, op9_backoff_lm, op10_sum_of_squares_packing, op11_bitmap_retention, op12_walsh_filter_audit, op13_crf_toxicity,
    )
    return {f.__name__: f for f in (*numbered, pipeline)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT rid, g FROM g GROUP BY rid, g HAVING count(*) > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g JOIN again USING (rid, g)) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, text, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
  length(text) - length(replace(text, chr(10), '')) AS breaks, length(text) - length(replace(text, '!', '')) AS shouts FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * (1 + breaks)) OR 2 * capitals > letters OR 2 * letters < word_chars OR 5 * shouts > n_words AS rejected FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM v"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN least USING (g) WHERE doc_id > first),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) a WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = a.doc_id AND gone.p = a.p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


#: CRC-32 by a table made from its polynomial; ids are decimal text.
_CRC_TABLE = "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t)"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


#: The bytes of a text are the pairs of digits of its hexadecimal form.
_BYTES_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'), lambda h: CAST(concat('0x', h) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

_OP6 = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
c AS (SELECT doc_id, size, CAST({_BYTES_CRC} AS BIGINT) AS text_crc32 FROM d, tab),
e AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32) AS last, sum(size) OVER () AS whole FROM c),
s AS (SELECT *, CAST(least((2 * last - size) * 16 // (2 * whole), 15) AS INTEGER) AS shard FROM e)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_OP11 = f"""
WITH {_CRC_TABLE},
c AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT c.*, CASE WHEN click_id IS NULL THEN NULL ELSE {_crc("CAST(click_id AS VARCHAR)")} END AS h FROM c, tab),
a AS (SELECT client_id, ts, kind, value, CASE WHEN h % 3 = 0 THEN arrived_at + to_days(CAST(h % 100 AS INTEGER)) ELSE arrived_at END AS arrival FROM h),
k AS (SELECT s.state, a.* FROM a, (VALUES (0), (1)) s(state) WHERE s.state = 1 OR arrival < TIMESTAMP '2024-02-15 00:00:00'),
b AS (SELECT state, client_id, min(ts) AS start FROM k WHERE kind = 'signup' GROUP BY 1, 2),
m AS (SELECT x.client_id FROM b x JOIN b y ON x.client_id = y.client_id AND x.state = 0 AND y.state = 1 WHERE CAST(x.start AS DATE) <> CAST(y.start AS DATE)),
g AS (SELECT client_id, coalesce(max(segment), '') AS segment FROM (SELECT *, rank() OVER (PARTITION BY client_id ORDER BY updated_at DESC NULLS LAST) AS r FROM clients) WHERE r = 1 GROUP BY 1),
r AS (SELECT state, client_id, coalesce(g.segment, '') AS segment, date_diff('day', DATE '1970-01-01', CAST(start AS DATE)) AS cohort, (epoch_us(ts) - epoch_us(start)) // 86400000000 AS period, CAST(floor(100 * coalesce(value, 0) + 0.5) AS BIGINT) AS cents
  FROM k JOIN b USING (state, client_id) LEFT JOIN g USING (client_id) WHERE ts >= start),
u AS (SELECT state, client_id, segment, cohort, period, sum(cents) AS cents FROM r GROUP BY ALL)
SELECT CAST(state AS INTEGER) AS state, segment, CAST(cohort AS BIGINT) AS cohort, CAST(period AS BIGINT) AS period, count(*) AS users, CAST(sum({_crc("CAST(client_id AS VARCHAR)")}) AS BIGINT) AS users_crc32,
  count(*) FILTER (client_id IN (SELECT client_id FROM m)) AS moved, CAST(sum(cents) AS BIGINT) AS cents FROM u, tab GROUP BY state, segment, cohort, period"""

_OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY 1),
e AS (SELECT text, min(doc_id) AS least FROM d GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
  CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM d JOIN e USING (text) LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(string_split('ABCDE', '')) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS c, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, c, sum(CASE WHEN NOT (had OR hit) THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT had THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND had THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN hit AND NOT had THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT had THEN toxic ELSE 0 END) AS toxic_lost FROM (SELECT *, contains(fails, c) AS hit, len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AND fails <> '' AS had FROM g, s) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; models, hashes of texts and searches have none."""
    return {"op2_quality_cascade": _OP2, "op5_debruijn_dedup": _OP5, "op6_byte_shards": _OP6, "op11_bitmap_retention": _OP11, "op12_walsh_filter_audit": _OP12}
