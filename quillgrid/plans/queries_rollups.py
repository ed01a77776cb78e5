"""Roll-up queries over jobs, events, caches and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgrid.functions import text as X
from quillgrid.operators import dedup as D, rollups as RU, statistics as ST
from quillgrid.plans.registry import query, table

NOW = "2024-01-29 00:00:00"
AS_OF = "2026-06-01 00:00:00"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingestion_job")


@query("WITH g AS (SELECT content, count(*) AS n, count(DISTINCT title) AS titles FROM documentation_entry WHERE content IS NOT NULL GROUP BY 1) SELECT count(*) AS groups, round(avg(n), 6) AS mean_size, round(avg((titles > 1)::int), 6) AS conflict_rate FROM g WHERE n > 1")
def copy_group_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documentation_entry").where("content is not null").select(F.sha2("content", 256).alias("h"), "title")
    groups = rows.groupBy("h", "title").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.count("title").alias("titles")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.avg((F.col("titles") > 1).cast("int")), 6).alias("conflict_rate"))


@query("SELECT library_id, count(*) AS n, round(avg(q), 6) AS mean, min(q) AS least, max(q) AS most FROM (SELECT library_id, coalesce(trust_score, 0.5) AS q FROM document_embedding) GROUP BY 1")
def library_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_embedding").select("library_id", F.coalesce("trust_score", F.lit(0.5)).alias("q"))
    return ST.numeric_summary(rows, ["library_id"], "q").select("library_id", "n", F.round("mean", 6).alias("mean"), "least", "most")


@query("WITH q AS (SELECT coalesce(trust_score, 0.5) / 10 AS s, * FROM document_embedding) SELECT CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.7 THEN 'good' WHEN s >= 0.5 THEN 'fair' ELSE 'low' END AS bucket, count(*) AS n, sum(coalesce(token_count, 0))::bigint AS tokens FROM q GROUP BY 1")
def quality_buckets(spark: SparkSession, d: str) -> DataFrame:
    s = F.coalesce("trust_score", F.lit(0.5)) / 10
    bucket = F.when(s >= 0.9, "high").when(s >= 0.7, "good").when(s >= 0.5, "fair").otherwise("low").alias("bucket")
    return table(spark, d, "document_embedding").groupBy(bucket).agg(F.count("*").alias("n"), F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("tokens"))


@query("SELECT library_id, count(*) AS n, round(avg(processing_time), 6) AS mean_seconds, max(processing_time) AS most_seconds, round(avg((status = 'completed')::int), 6) AS success_rate, round(avg((error_message IS NOT NULL)::int), 6) AS error_rate FROM ingestion_job GROUP BY 1")
def trigger_stats(spark: SparkSession, d: str) -> DataFrame:
    out = _jobs(spark, d).groupBy("library_id").agg(F.count("*").alias("n"), F.avg("processing_time").alias("m"), F.max("processing_time").alias("most_seconds"), F.avg((F.col("status") == "completed").cast("int")).alias("s"), F.avg(F.col("error_message").isNotNull().cast("int")).alias("e"))
    return out.select("library_id", "n", F.round("m", 6).alias("mean_seconds"), "most_seconds", F.round("s", 6).alias("success_rate"), F.round("e", 6).alias("error_rate"))


@query("SELECT library_id, sum(coalesce(token_count, 0))::bigint AS tokens, round(least(sum(coalesce(token_count, 0)) * 100.0::double / 5000, 100), 6) AS coverage, count(*) FILTER (WHERE content IS NULL OR trim(content) = '') AS empty FROM document_embedding GROUP BY 1")
def download_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_embedding").groupBy("library_id").agg(F.sum(F.coalesce("token_count", F.lit(0))).cast("bigint").alias("tokens"), F.count(F.when(F.coalesce(F.trim("content"), F.lit("")) == "", 1)).alias("empty"))
    return rows.select("library_id", "tokens", F.round(RU.coverage(F.col("tokens"), F.lit(5000)), 6).alias("coverage"), "empty")


@query("WITH j AS (SELECT job_id, any_value(library_id) AS library_id, max(processing_attempts) AS attempts, bool_or(error_message IS NOT NULL) AS erred, bool_or(status = 'completed') AS done FROM ingestion_job GROUP BY 1) SELECT library_id, count(*) FILTER (WHERE erred) AS erred, count(*) FILTER (WHERE erred AND done) AS recovered, max(attempts) AS most_attempts FROM j GROUP BY 1")
def recovery_stats(spark: SparkSession, d: str) -> DataFrame:
    each = _jobs(spark, d).groupBy("job_id").agg(F.max("library_id").alias("library_id"), F.max("processing_attempts").alias("attempts"), F.max(F.col("error_message").isNotNull()).alias("erred"), F.max(F.col("status") == "completed").alias("done"))
    return each.groupBy("library_id").agg(F.count(F.when(F.col("erred"), 1)).alias("erred"), F.count(F.when(F.col("erred") & F.col("done"), 1)).alias("recovered"), F.max("attempts").alias("most_attempts"))


_RANK = "CASE status WHEN 'completed' THEN 0 WHEN 'queued' THEN 1 WHEN 'processing' THEN 2 WHEN 'retrying' THEN 3 WHEN 'failed' THEN 4 ELSE 5 END"


@query(f"SELECT library_id, ['completed', 'queued', 'processing', 'retrying', 'failed', 'unknown'][max({_RANK}) + 1] AS worst, count(*) AS n, " + ", ".join(f"sum((status IS NOT NULL AND status = '{s}')::int)::bigint AS {s}" for s in RU.SEVERITY) + " FROM ingestion_job GROUP BY 1")
def library_health(spark: SparkSession, d: str) -> DataFrame:
    return RU.worst_state(_jobs(spark, d), ["library_id"], "status")


@query("SELECT lang, count(*) AS n, round(max(b / c), 6) AS best, round(min(b / c), 6) AS worst, round(avg(b / c), 6) AS mean, round(avg((b - c) / b), 6) AS share FROM (SELECT lang, octet_length(encode(text))::double AS b, length(text)::double AS c FROM documents WHERE length(text) > 0) GROUP BY 1")
def compression_stats(spark: SparkSession, d: str) -> DataFrame:
    """Bytes against characters of the texts: what a code of one byte a character would save."""
    m = RU.saved(F.octet_length("text"), F.length("text"))
    rows = table(spark, d, "documents").where(F.length("text") > 0).select("lang", m["factor"].alias("f"), m["share"].alias("s"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *[F.round(a, 6).alias(k) for k, a in (("best", F.max("f")), ("worst", F.min("f")), ("mean", F.avg("f")), ("share", F.avg("s")))])


@query("""WITH r AS (SELECT user_id, floor(value / 20)::bigint AS size, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20),
    m AS (SELECT user_id, size, avg(value) AS score FROM r GROUP BY 1, 2 HAVING count(*) >= 3) SELECT user_id, size, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, size) = 1""")
def best_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's last 20 values, the band of values with at least three of the greatest mean."""
    recent = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, d, "events").where("value is not null").withColumn("_i", recent).where("_i <= 20").select("user_id", F.floor(F.col("value") / 20).cast("bigint").alias("size"), "value")
    return RU.best_by(rows, ["user_id"], "size", F.col("value"), 3).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT started_at AS t, 1 AS step FROM ingestion_job WHERE started_at IS NOT NULL UNION ALL SELECT completed_at, -1 FROM ingestion_job WHERE started_at IS NOT NULL AND completed_at IS NOT NULL),
    c AS (SELECT t, step, sum(step) AS change FROM s GROUP BY 1, 2) SELECT max(o)::bigint AS peak FROM (SELECT sum(change) OVER (ORDER BY t, step) AS o FROM c)""")
def job_peak(spark: SparkSession, d: str) -> DataFrame:
    return RU.peak_concurrency(_jobs(spark, d), "started_at", "completed_at")


@query("SELECT o_orderkey, round(sum(o_totalprice::decimal(18, 2)) OVER (ORDER BY o_orderdate, o_orderkey)::double, 2) AS total FROM orders")
def order_running_total(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return RU.running_total(rows, ["o_orderdate", "o_orderkey"], "price").select("o_orderkey", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("""WITH j AS (SELECT library_id, count(DISTINCT job_id) AS jobs, sum(vectors_created)::bigint AS vectors FROM ingestion_job GROUP BY 1), t AS (SELECT library_id, count(*) AS documents, count(DISTINCT version) AS versions FROM documents GROUP BY 1)
    SELECT t.library_id, documents, versions, coalesce(jobs, 0) AS jobs, coalesce(vectors, 0) AS vectors FROM t LEFT JOIN j ON t.library_id = j.library_id""")
def processing_overview(spark: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(spark, d).groupBy("library_id").agg(F.countDistinct("job_id").alias("jobs"), F.sum("vectors_created").alias("vectors"))
    docs = table(spark, d, "documents").groupBy("library_id").agg(F.count("*").alias("documents"), F.countDistinct("version").alias("versions"))
    return docs.join(jobs, "library_id", "left").select("library_id", "documents", "versions", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("vectors", F.lit(0)).cast("bigint").alias("vectors"))


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(ts) AS newest, count(*) FILTER (WHERE value >= 50) AS alerts FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY 1")
def health_last_day(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    rows = table(spark, d, "events").where((F.col("ts") > now - F.expr("interval 24 hours")) & (F.col("ts") <= now))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("newest"), F.count(F.when(F.col("value") >= 50, 1)).alias("alerts"))


@query(f"SELECT event_id, event_type, value FROM events WHERE value >= 80 AND ts > TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = events.user_id AND r.event_type = 'purchase' AND r.ts > events.ts)")
def open_alerts(spark: SparkSession, d: str) -> DataFrame:
    """High values of the last 48 hours that no purchase of the same user has followed."""
    rows = table(spark, d, "events")
    last = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("resolved"))
    recent = rows.where((F.col("value") >= 80) & (F.col("ts") > F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 48 hours")))
    return recent.join(last, "user_id", "left").where("resolved is null or resolved <= ts").select("event_id", "event_type", "value")


@query("SELECT model, input_type, count(*) AS entries, sum((access_count > 0)::int)::bigint AS used, round(avg((access_count > 0)::int), 6) AS hit_rate FROM embedding_cache GROUP BY 1, 2")
def cache_performance(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("access_count") > 0).cast("int")
    return table(spark, d, "embedding_cache").groupBy("model", "input_type").agg(F.count("*").alias("entries"), F.sum(hit).alias("used"), F.round(F.avg(hit), 6).alias("hit_rate"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(avg((value >= 50)::int), 6) AS hit_rate FROM events GROUP BY 1, 2")
def search_analytics(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")
    return table(spark, d, "events").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") >= 50).cast("int")), 6).alias("hit_rate"))


@query(f"SELECT DISTINCT job_id FROM ingestion_job WHERE status IN ('failed', 'retrying') AND processing_attempts <= max_retries AND last_error_at > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND job_id NOT IN (SELECT job_id FROM ingestion_job WHERE status = 'completed')")
def retryable_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = _jobs(spark, d)
    failed = rows.where(F.col("status").isin("failed", "retrying") & (F.col("processing_attempts") <= F.col("max_retries")) & (F.col("last_error_at") > F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 365 days")))
    return failed.join(rows.where("status = 'completed'").select("job_id"), "job_id", "left_anti").select("job_id").distinct()


@query("SELECT job_id, library_id, coalesce(regexp_full_match(library_id, '/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+'), false) AS id_ok, coalesce(regexp_full_match(version, 'v?[0-9]+(\\.[0-9]+)*'), false) AS version_ok FROM (SELECT DISTINCT job_id, library_id, version FROM ingestion_job)")
def valid_ids(spark: SparkSession, d: str) -> DataFrame:
    ok = lambda c, p: F.coalesce(F.col(c).rlike(p), F.lit(False))
    return _jobs(spark, d).select("job_id", "library_id", "version").distinct().select("job_id", "library_id", ok("library_id", r"\A/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\z").alias("id_ok"), ok("version", r"\Av?[0-9]+(\.[0-9]+)*\z").alias("version_ok"))


@query("SELECT doc_id, md5(CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') ELSE text END) AS cut FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents WHERE length(trim(text)) >= 50)")
def cut_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts of 50 characters or more, cut to 100 words where they are longer."""
    rows = table(spark, d, "documents").where(F.length(F.trim("text")) >= 50)
    return rows.select("doc_id", F.md5(X.cut_words(F.col("text"), 100)).alias("cut"))


@query("SELECT library_id, entry_id, (row_number() OVER (PARTITION BY library_id ORDER BY length(description) DESC, description, entry_id))::int AS place FROM documentation_entry WHERE description IS NOT NULL QUALIFY place <= 7")
def longest_descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documentation_entry").where("description is not null").select("library_id", "entry_id", "description")
    order = Window.partitionBy("library_id").orderBy(F.desc(F.length("description")), "description", "entry_id")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 7").select("library_id", "entry_id", "place")


@query(f"SELECT cache_id, CASE WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at) <= 24 * 3600000000 THEN 0.5 WHEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at) <= 168 * 3600000000 THEN 0.3 ELSE 0 END::double AS boost FROM embedding_cache")
def recency_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedding_cache").select("cache_id", X.recency_step(F.col("created_at"), F.lit(AS_OF).cast("timestamp_ntz")).alias("boost"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(count(*) / 60.0::double, 6) AS per_minute FROM events GROUP BY 1")
def hourly_throughput(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    return table(spark, d, "events").groupBy(hour).agg(F.count("*").alias("n")).withColumn("per_minute", F.round(F.col("n") / 60.0, 6))


@query("""WITH q AS (SELECT content_hash, count(*) AS n, max(parsed_at) AS asked_at FROM documentation_entry WHERE content_hash IS NOT NULL GROUP BY 1)
    SELECT cache_id, coalesce(access_count, 0) + coalesce(n, 0) AS access_count, greatest(accessed_at, asked_at) AS accessed_at FROM embedding_cache LEFT JOIN q USING (content_hash)""")
def touched_cache(spark: SparkSession, d: str) -> DataFrame:
    out = RU.touched(table(spark, d, "embedding_cache"), table(spark, d, "documentation_entry"), "content_hash", "access_count", "accessed_at", "parsed_at")
    return out.select("cache_id", "access_count", "accessed_at")


@query("SELECT entry_id FROM documentation_entry WHERE content IS NOT NULL AND content IN (SELECT content FROM documentation_entry GROUP BY 1 HAVING count(*) = 1)")
def entries_without_copies(spark: SparkSession, d: str) -> DataFrame:
    """Entries that are in no group of copies."""
    rows = table(spark, d, "documentation_entry").where("content is not null")
    grouped = D.exact_groups(rows, "content", "entry_id").where("copies > 1").select("digest")
    return rows.withColumn("digest", F.sha2("content", 256)).join(grouped, "digest", "left_anti").select("entry_id")


@query("SELECT library_id, technology, n FROM (SELECT library_id, CASE WHEN lower(content) LIKE '%session%' THEN 'session' END AS technology, count(*) AS n FROM document_embedding GROUP BY 1, 2) WHERE technology IS NOT NULL AND n > 1")
def library_terms(spark: SparkSession, d: str) -> DataFrame:
    """Libraries with more than one content that speaks of sessions."""
    rows = table(spark, d, "document_embedding").where(F.lower("content").contains("session"))
    return rows.groupBy("library_id").agg(F.count("*").alias("n")).where("n > 1").select("library_id", F.lit("session").alias("technology"), "n")
