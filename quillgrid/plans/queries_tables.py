"""Queries over keyed tables, logs and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgrid.operators import dedup as D, statistics as ST, tables as TB
from quillgrid.plans.registry import query, table
from quillgrid.sources.writers import version_id, version_time

AS_OF = "2026-09-01 00:00:00"


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_groups(table(spark, d, "documents"), "text", "doc_id")


@query("WITH g AS (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT sum(c)::bigint AS original, count(*) AS kept, (sum(c) - count(*))::bigint AS removed, round((sum(c) - count(*))::double / sum(c), 6) AS ratio FROM g")
def exact_copy_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = D.dedup_metrics(D.exact_groups(table(spark, d, "documents"), "text", "doc_id"))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("SELECT content, entry_id, library_id FROM documentation_entry QUALIFY row_number() OVER (PARTITION BY content ORDER BY coalesce(length(title), 0) + coalesce(length(description), 0) DESC, entry_id) = 1")
def best_copies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documentation_entry").select("content", "entry_id", "library_id", "title", "description")
    rows = rows.withColumn("digest", F.coalesce(F.sha2("content", 256), F.lit("")))  # groups are keyed by a hash, texts are joined back
    size = F.coalesce(F.length("title"), F.lit(0)) + F.coalesce(F.length("description"), F.lit(0))
    best = D.keep_best(rows.select("digest", "entry_id", size.alias("size")), ["digest"], F.col("size"), ["entry_id"])
    return rows.join(best.select("digest", "entry_id"), ["digest", "entry_id"]).dropDuplicates(["digest"]).select("content", "entry_id", "library_id")


@query("SELECT doc_id, round(log10(length(text) + 1) + least(len(regexp_extract_all(text, '```')) * 0.5::double, 2.0) + least(len(regexp_extract_all(text, 'GET|POST|PUT|DELETE')) * 0.2::double, 1.0) + least(((length(lower(text)) - length(replace(lower(text), 'example', ''))) // 7) * 0.3::double, 1.5), 6) AS quality FROM documents")
def copy_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(D.text_quality(F.col("text")), 6).alias("quality"))


_SETS = r"list_distinct(list_filter(regexp_split_to_array(lower(title), '[ \t\n\r\f]+'), lambda w: w <> ''))"


@query(f"""WITH e AS (SELECT entry_id, library_id, list_sort({_SETS}) AS w FROM documentation_entry WHERE title IS NOT NULL AND library_id IS NOT NULL), s AS (SELECT library_id, w, min(entry_id) AS entry_id FROM e WHERE len(w) > 0 GROUP BY 1, 2),
    p AS (SELECT a.entry_id AS a, b.entry_id AS b, len(list_intersect(a.w, b.w))::double AS c, len(a.w) + len(b.w) AS n FROM s a JOIN s b ON a.library_id = b.library_id AND a.entry_id < b.entry_id)
    SELECT a, b, round(c / (n - c), 6) AS similarity FROM p WHERE c / (n - c) >= 0.6""")
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    out = D.similar_pairs(table(spark, d, "documentation_entry"), ["library_id"], "entry_id", "title", 0.6)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE s AS (SELECT entry_id, library_id, {_SETS} AS w FROM documentation_entry WHERE title IS NOT NULL),
    p AS (SELECT a.entry_id AS a, b.entry_id AS b, len(list_intersect(a.w, b.w))::double AS c, len(a.w) + len(b.w) AS n FROM s a JOIN s b ON a.library_id = b.library_id AND a.entry_id <> b.entry_id),
    e AS (SELECT a, b FROM p WHERE c / (n - c) >= 0.6), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
    SELECT node AS entry_id, min(reach) AS component FROM r GROUP BY node""")
def similar_title_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documentation_entry").where("library_id is not null")
    sets = D.word_sets(rows, ["library_id"], "entry_id", D.space_words(F.col("title")))
    return D.similar_groups(sets, D.similar_classes(sets, ["library_id"], 0.6)).select(F.col("id").alias("entry_id"), "component")


@query()
def diverse_sections(spark: SparkSession, d: str) -> DataFrame:
    return D.keep_diverse(table(spark, d, "document_embedding"), ["library_id", "version", "section"], "id", "content")


@query("SELECT DISTINCT ON (id) id, library_id, version, token_count, indexed_at FROM (SELECT DISTINCT id, library_id, version, token_count, indexed_at FROM document_embedding) ORDER BY id, indexed_at DESC NULLS LAST, library_id DESC NULLS LAST")
def latest_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_embedding").select("id", "library_id", "version", "token_count", "indexed_at")
    return TB.latest_by_key(rows, ["id"], ["indexed_at", "library_id"])


@query("SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return TB.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 <> 0"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, ts, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")
def changes_with_deletes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "value", (F.col("event_type") == "error").alias("gone"))
    out = TB.apply_changes(rows.drop("gone").limit(0), rows, ["user_id"], ["ts", "event_id"], "gone")
    return out.select("user_id", "ts", "value")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, o_orderdate) FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) <= 5)")
def version_retention(spark: SparkSession, d: str) -> DataFrame:
    return TB.keep_versions(table(spark, d, "orders"), "o_custkey", "o_orderdate", 5).select("o_custkey", "o_orderkey")


@query("""WITH v AS (SELECT library_id, version, count(*) AS n, sum(coalesce(octet_length(encode(text)), 0)) AS s FROM documents GROUP BY 1, 2)
    SELECT library_id, count(DISTINCT version) AS versions, sum(n)::bigint AS rows, sum(s)::bigint AS total, max(s)::bigint AS largest, max(version) AS newest FROM v GROUP BY ROLLUP (library_id)""")
def storage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return TB.version_rollup(table(spark, d, "documents"), "library_id", "version", F.coalesce(F.octet_length("text"), F.lit(0)))


@query(f"SELECT cache_id, model FROM embedding_cache WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 120 DAY")
def unexpired_cache(spark: SparkSession, d: str) -> DataFrame:
    return TB.unexpired(table(spark, d, "embedding_cache"), "created_at", F.lit(AS_OF).cast("timestamp_ntz"), 120 * 86400).select("cache_id", "model")


@query("SELECT cache_id FROM embedding_cache ORDER BY accessed_at DESC NULLS LAST, access_count DESC NULLS LAST, cache_id DESC LIMIT 800")
def cache_after_eviction(spark: SparkSession, d: str) -> DataFrame:
    return TB.evict_least_used(table(spark, d, "embedding_cache"), "accessed_at", "access_count", "cache_id", 1000).select("cache_id")


@query("SELECT model, count(*) AS entries, round(avg(access_count), 6) AS mean_access, min(created_at) AS oldest, max(created_at) AS newest, sum(length(content))::bigint AS characters FROM embedding_cache GROUP BY model")
def cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedding_cache").groupBy("model").agg(F.count("*").alias("entries"), F.round(F.avg("access_count"), 6).alias("mean_access"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.sum(F.length("content")).alias("characters"))


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = table(spark, d, "documentation_entry").select("entry_id", F.lower("content_hash").alias("content_hash"))
    return asked, table(spark, d, "embedding_cache").select(F.lower("content_hash").alias("content_hash"), "cache_id", "model")


@query("SELECT entry_id, lower(content_hash) AS content_hash FROM documentation_entry WHERE lower(content_hash) IN (SELECT lower(content_hash) FROM embedding_cache WHERE content_hash IS NOT NULL)")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return TB.cache_probe(*_requests(spark, d), ["content_hash"])[0]


@query("SELECT entry_id, lower(content_hash) AS content_hash FROM documentation_entry e WHERE NOT EXISTS (SELECT 1 FROM embedding_cache c WHERE lower(c.content_hash) = lower(e.content_hash))")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return TB.cache_probe(*_requests(spark, d), ["content_hash"])[1]


@query("""WITH a AS (SELECT content_hash, min(cache_id) AS v FROM embedding_cache WHERE cache_id % 2 = 0 GROUP BY 1), b AS (SELECT content_hash, min(cache_id) AS v FROM embedding_cache WHERE cache_id % 2 = 1 GROUP BY 1)
    SELECT entry_id, e.content_hash, coalesce(a.v, b.v) AS cache_id, CASE WHEN a.v IS NOT NULL THEN 'cached' WHEN b.v IS NOT NULL THEN 'computed' ELSE 'failed' END AS status FROM documentation_entry e LEFT JOIN a USING (content_hash) LEFT JOIN b USING (content_hash)""")
def combined_results(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "embedding_cache").groupBy("content_hash", (F.col("cache_id") % 2).alias("half")).agg(F.min("cache_id").alias("cache_id"))
    asked = table(spark, d, "documentation_entry").select("entry_id", "content_hash")
    return TB.combine_results(asked, cache.where("half = 0"), cache.where("half = 1"), "content_hash", "cache_id")


@query("SELECT job_id, ((row_number() OVER (ORDER BY job_id) - 1) // 50)::bigint AS batch_id FROM (SELECT DISTINCT job_id FROM ingestion_job WHERE job_id IS NOT NULL)")
def job_batches(spark: SparkSession, d: str) -> DataFrame:
    return TB.batches(table(spark, d, "ingestion_job").where("job_id is not null").select("job_id").distinct(), "job_id", 50)


@query("SELECT event_type, count(*) AS n, list_sort(list(value))[least(floor(count(*) * 0.5), count(*) - 1)::int + 1] AS p50, list_sort(list(value))[least(floor(count(*) * 0.95), count(*) - 1)::int + 1] AS p95, list_sort(list(value))[least(floor(count(*) * 0.99), count(*) - 1)::int + 1] AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ST.nearest_rank(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query()
def approximate_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ST.approximate_percentiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT user_id, count(*) AS n, sum((event_type = 'error')::int)::bigint AS error_n, round(avg((event_type = 'error')::int), 6) AS error_rate, sum((event_type = 'purchase')::int)::bigint AS purchase_n, round(avg((event_type = 'purchase')::int), 6) AS purchase_rate FROM events GROUP BY user_id")
def outcome_rates(spark: SparkSession, d: str) -> DataFrame:
    out = ST.rates(table(spark, d, "events"), ["user_id"], {"error": F.col("event_type") == "error", "purchase": F.col("event_type") == "purchase"})
    return out.withColumn("error_rate", F.round("error_rate", 6)).withColumn("purchase_rate", F.round("purchase_rate", 6))


@query("SELECT event_type, count(*) AS n, round(count(*)::double / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def event_shares(spark: SparkSession, d: str) -> DataFrame:
    return ST.value_shares(table(spark, d, "events"), "event_type").select("event_type", "n", F.round("share", 6).alias("share"))


@query("SELECT library_id, sum((status = 'queued')::int)::bigint AS queued, sum((status = 'processing')::int)::bigint AS processing, sum((status = 'completed')::int)::bigint AS completed, sum((status = 'failed')::int)::bigint AS failed FROM ingestion_job GROUP BY library_id")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ingestion_job").withColumn("status", F.coalesce("status", F.lit("(none)")))
    return ST.pivot_counts(rows, "library_id", "status", ["queued", "processing", "completed", "failed"])


@query("SELECT job_id, round(max(epoch_us(started_at) - epoch_us(created_at)) / 1e6, 6) AS wait_seconds, round(max(epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 6) AS run_seconds FROM ingestion_job GROUP BY job_id")
def job_durations(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return table(spark, d, "ingestion_job").groupBy("job_id").agg(F.round(F.max(us("started_at") - us("created_at")) / 1e6, 6).alias("wait_seconds"), F.round(F.max(us("completed_at") - us("started_at")) / 1e6, 6).alias("run_seconds"))


@query("WITH r AS (SELECT DISTINCT * FROM dedup_result) SELECT run_id, round(max(1 - deduplicated_count::double / nullif(original_count, 0)), 6) AS ratio, round(max(original_count / nullif(processing_time, 0)), 6) AS per_second FROM r GROUP BY run_id")
def dedup_run_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dedup_result").distinct()
    return rows.groupBy("run_id").agg(F.round(F.max(1 - F.try_divide("deduplicated_count", F.col("original_count").cast("double"))), 6).alias("ratio"), F.round(F.max(F.try_divide(F.col("original_count").cast("double"), F.col("processing_time"))), 6).alias("per_second"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running_mean FROM events")
def running_mean(spark: SparkSession, d: str) -> DataFrame:
    return ST.running_mean(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round(F.col("running_mean") + 1e-9, 6).alias("running_mean"))


@query("SELECT event_id, round(avg(value) OVER w, 6) AS last_mean, max(value) OVER w AS last_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def last_five(spark: SparkSession, d: str) -> DataFrame:
    return ST.last_n(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", F.round("last_mean", 6).alias("last_mean"), "last_max")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events QUALIFY i <= 10)
    SELECT user_id, count(*) AS n, round(regr_slope(value, -i), 6) AS slope, CASE WHEN regr_slope(value, -i) > 0.1 THEN 'increasing' WHEN regr_slope(value, -i) < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM r GROUP BY user_id""")
def value_trends(spark: SparkSession, d: str) -> DataFrame:
    return ST.trend(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").withColumn("slope", F.round("slope", 6))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
    SELECT user_id, max(n) AS n, round(sum(pow(0.8, b) * CASE WHEN b = n - 1 THEN 1.0::double ELSE 0.2::double END * value), 6) AS ema FROM r GROUP BY user_id""")
def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("place", F.struct("ts", "event_id"))
    return ST.moving_average(rows, ["user_id"], "place", "value").withColumn("ema", F.round("ema", 6))


@query("SELECT floor(value / 10)::bigint AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ST.histogram(table(spark, d, "events"), "value", 10)


@query("""WITH g AS (SELECT library_id, version, count(*) AS chunks, sum(token_count)::bigint AS tokens, round(avg(trust_score), 6) AS trust FROM document_embedding GROUP BY 1, 2),
    l AS (SELECT library_id, version, programming_language, count(*) AS n FROM document_embedding WHERE programming_language IS NOT NULL GROUP BY 1, 2, 3),
    h AS (SELECT library_id, version, string_agg(programming_language || '=' || n, ',' ORDER BY programming_language) AS languages FROM l GROUP BY 1, 2)
    SELECT g.*, h.languages FROM g LEFT JOIN h ON g.library_id IS NOT DISTINCT FROM h.library_id AND g.version IS NOT DISTINCT FROM h.version""")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_embedding")
    keys = ["library_id", "version"]
    each = rows.groupBy(*keys, "programming_language").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"), F.sum("trust_score").alias("s"), F.count("trust_score").alias("k"))
    named = F.array_sort(F.collect_list(F.when(F.col("programming_language").isNotNull(), F.struct("programming_language", "n"))))  # one for each language
    out = each.groupBy(*keys).agg(F.sum("n").alias("chunks"), F.sum("t").alias("tokens"), F.round(F.sum("s") / F.sum("k"), 6).alias("trust"), named.alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: F.concat(x["programming_language"], F.lit("="), x["n"].cast("string"))), ",")
    return out.select(*keys, "chunks", "tokens", "trust", F.when(F.size("ls") > 0, text).alias("languages"))


@query("SELECT job_id, min(epoch_us(created_at)) AS micros FROM ingestion_job GROUP BY job_id")
def version_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ingestion_job").groupBy("job_id").agg(version_id(F.min("created_at").cast("timestamp")).alias("v"))
    return rows.select("job_id", F.unix_micros(version_time(F.col("v"))).alias("micros"))


@query("SELECT job_id, priority, created_at, (row_number() OVER (ORDER BY priority DESC, created_at, job_id))::int AS place FROM (SELECT DISTINCT job_id, priority, created_at FROM ingestion_job WHERE status = 'queued') ORDER BY place LIMIT 20")
def queue_head(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ingestion_job").where("status = 'queued'").select("job_id", "priority", "created_at").distinct()
    head = rows.orderBy(F.desc("priority"), "created_at", "job_id").limit(20)
    return head.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "created_at", "job_id")))  # 20 rows
