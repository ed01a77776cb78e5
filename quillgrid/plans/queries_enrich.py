"""Queries that draw entities, tags, weights and issues from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.functions import patterns as P, vectors as V
from quillgrid.operators import enrich as E, statistics as ST
from quillgrid.operators.relational import join_null_safe
from quillgrid.plans.registry import query, table

_NO = ", ".join(f"'{k}'" for k in E.NO_KEYS)


def _all(pattern: str, text: str = "text") -> str:
    return f"list_sort(list_distinct(regexp_extract_all(coalesce({text}, ''), '{pattern}', 1)))"


_FENCED = f"list_transform({_all(E.FENCED_CODE)}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)))"
_BOTH = f"list_concat({_FENCED}, list_filter({_all(E.INLINE_CODE)}, lambda y: NOT list_contains({_FENCED}, y)))"


@query(f"SELECT doc_id, array_to_string({_all(E.ENDPOINT)}[1:10], '|') AS endpoints, array_to_string(list_filter({_BOTH}, lambda x: x <> '' AND length(x) < 500)[1:5], '|') AS snippets FROM documents")
def document_entities(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(E.endpoints(t), "|").alias("endpoints"), F.array_join(E.code_snippets(t), "|").alias("snippets"))


@query(f"SELECT entry_id, array_to_string(list_sort(list_distinct(list_filter(list_concat({_all(E.SETTING, 'content')}, {_all(E.FLAG, 'content')}), lambda k: lower(k) NOT IN ({_NO}))))[1:20], '|') AS keys FROM documentation_entry")
def setting_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documentation_entry").select("entry_id", F.array_join(E.setting_keys(F.col("content")), "|").alias("keys"))


@query()
def entry_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documentation_entry").select("entry_id", E.tags(F.col("content")).alias("tags"))


_STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)


@query(f"""WITH w AS (SELECT entry_id AS doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]{{2,}}'), lambda x: x NOT IN ({_STOP}))) AS term FROM documentation_entry),
    t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 2),
    x AS (SELECT doc_id, term, tf * (ln(((SELECT count(DISTINCT entry_id) FROM documentation_entry) + 1) / (df + 1)) + 1) AS x FROM t JOIN f USING (term)),
    n AS (SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x)
    SELECT doc_id, term, weight FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 3""")
def title_term_weights(spark: SparkSession, d: str) -> DataFrame:
    return E.term_weights(table(spark, d, "documentation_entry"), "entry_id", "title", 3)


@query("""SELECT id, rule, severity FROM (SELECT id, unnest([CASE WHEN content IS NULL OR trim(content, ' ') = '' THEN {'rule': 'no content', 'severity': 'error'} END,
    CASE WHEN token_count IS NULL OR token_count <= 0 THEN {'rule': 'no token count', 'severity': 'warning'} END, CASE WHEN chunk_index >= total_chunks THEN {'rule': 'index over total', 'severity': 'error'} END,
    CASE WHEN library_id IS NULL THEN {'rule': 'no library', 'severity': 'warning'} END, CASE WHEN len(embedding) <> 8 THEN {'rule': 'dimension', 'severity': 'error'} END]) AS i FROM document_embedding)
    , LATERAL (SELECT i.rule AS rule, i.severity AS severity) WHERE i IS NOT NULL""")
def chunk_issues(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rules = {
        "no content": ("error", c("content").isNull() | (F.trim("content") == "")),
        "no token count": ("warning", c("token_count").isNull() | (c("token_count") <= 0)),
        "index over total": ("error", c("chunk_index") >= c("total_chunks")),
        "no library": ("warning", c("library_id").isNull()),
        "dimension": ("error", F.size("embedding") != 8),
    }
    return E.issues(table(spark, d, "document_embedding"), "id", rules)


@query("SELECT id, round(coalesce(greatest(0.0::double, (365 - greatest(0, date_diff('day', indexed_at::date, DATE '2026-09-01'))) / 365.0::double) * 0.1, 0), 6) AS recency FROM document_embedding")
def recency_boosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_embedding").select("id", F.round(E.recency(F.col("indexed_at"), F.lit("2026-09-01").cast("date")), 6).alias("recency"))


_E8 = "[" + ", ".join(["0.5"] * 8) + "]"


@query(f"""WITH s AS (SELECT DISTINCT id, list_cosine_similarity(embedding::double[], {_E8}::double[]) AS s, trust_score, doc_type, section FROM document_embedding),
    b AS (SELECT id, round(s * CASE WHEN trust_score >= 9 THEN 1.3 WHEN trust_score >= 7 THEN 1.15 WHEN trust_score >= 5 THEN 1.05 ELSE 1.0 END * CASE WHEN doc_type = 'tutorial' THEN 1.2 ELSE 1.0 END
    * CASE WHEN contains(lower(section), 'entry') THEN 1.1 ELSE 1.0 END, 6) AS score FROM s WHERE s > 0) SELECT id, max(score) AS score FROM b GROUP BY id ORDER BY score DESC, id LIMIT 25""")
def boosted_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_embedding").select("id", V.cosine(F.col("embedding"), F.array(*[F.lit(0.5)] * 8)).alias("s"), "trust_score", "doc_type", "section").where("s > 0")
    score = F.round(E.boosted(F.col("s"), F.col("trust_score"), F.col("doc_type"), F.col("section"), "tutorial", "entry"), 6)
    return rows.groupBy("id").agg(F.max(score).alias("score")).orderBy(F.desc("score"), "id").limit(25)


@query("""SELECT CASE WHEN regexp_matches(lower(title), '^(how|why)[^a-z]|how to') THEN 'howto' WHEN regexp_matches(lower(title), 'error|fail|fix|problem|issue') THEN 'troubleshooting'
    WHEN regexp_matches(lower(title), 'api|reference|parameter|notes on') THEN 'reference' WHEN regexp_matches(lower(title), 'example|sample|demo') THEN 'example' ELSE 'lookup' END AS intent, count(*) AS n FROM documentation_entry WHERE title IS NOT NULL GROUP BY 1""")
def title_intents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documentation_entry").where("title is not null").groupBy(E.query_intent(F.col("title")).alias("intent")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25 OFFSET 50")
def document_page(spark: SparkSession, d: str) -> DataFrame:
    return E.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc_nulls_last("n_chars"), F.col("doc_id")], 3, 25)


@query("""SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY 1, 2""")
def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), "event_type", "value")
    keys = ["day", "event_type"]
    every = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    middle = ST.median(rows, keys, "value").select(*keys, F.round("median", 6).alias("p50"))
    return join_null_safe(every, middle, keys, "left")


_AT = "list_sort(list(value))[least(floor(count(value) * {}), count(value) - 1)::int + 1]"


@query(f"""SELECT date_trunc('month', ts) AS month, event_type, count(value) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most, {_AT.format(0.5)} AS p50, {_AT.format(0.95)} AS p95, {_AT.format(0.99)} AS p99
    FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a metrics table by metric and month: sums, bounds and exact percentiles."""
    rows = table(spark, d, "events").where("value is not null").select(F.date_trunc("month", F.col("ts")).cast("timestamp_ntz").alias("month"), "event_type", "value")
    keys = ["month", "event_type"]
    sums = ST.numeric_summary(rows, keys, "value").select(*keys, F.round("total", 6).alias("total"), "least", "most")
    ranks = ST.nearest_rank(rows, keys, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return join_null_safe(sums, ranks, keys)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 50")
def largest_documents(spark: SparkSession, d: str) -> DataFrame:
    """A report for which 80 rows were wished and at most 50 are given."""
    rows = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars")
    return E.page(rows, [F.desc("n_chars"), F.col("doc_id")], 1, E.clamp(80))


@query("""WITH g AS (SELECT library_id, version, doc_type, count(*) AS n FROM document_embedding WHERE doc_type IS NOT NULL AND doc_type <> '' GROUP BY 1, 2, 3)
    SELECT library_id, version, count(*) AS types, string_agg(doc_type || '=' || n, ',' ORDER BY doc_type) AS histogram, coalesce(string_agg(doc_type, ',' ORDER BY doc_type) FILTER (WHERE n > 1), '') AS repeated FROM g GROUP BY 1, 2""")
def collection_types(spark: SparkSession, d: str) -> DataFrame:
    """The types of documents of each library's version with their numbers, and those met more than once."""
    rows = table(spark, d, "document_embedding").where("doc_type is not null and doc_type <> ''")
    return ST.histogram_texts(rows, ["library_id", "version"], "doc_type").withColumnRenamed("values", "types")
