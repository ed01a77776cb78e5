"""Queries that classify, score and cut texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.functions import hashing as H, patterns as P, text as X
from quillgrid.operators import chunking, documents
from quillgrid.plans.registry import query, table

_DOCS, _ENTRIES, _EMB = "documents", "documentation_entry", "document_embedding"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


def _weighted(text: str, weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"{_count(text, p)} * {w}::double" for p, w in weights.items()) + ")"


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f]+'), lambda w: w <> ''))"


@query(
    rf"""SELECT doc_id, {_WORDS}::int AS words, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::int AS lines,
    coalesce({_count('text', '[.!?]+')}, 0)::int AS sentences, coalesce(length(text), 0)::int AS characters,
    greatest({_WORDS}, coalesce(length(text), 0) // 4)::bigint AS token_estimate FROM documents"""
)
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, _DOCS).select(
        "doc_id", X.word_count(t).alias("words"), X.line_count(t).alias("lines"), X.sentence_count(t).alias("sentences"),
        X.zero_if_null(F.length(t)).alias("characters"), X.token_estimate(t).alias("token_estimate"),
    )


@query("SELECT doc_id, left(sha256(text), 16) AS content_hash, md5(lower(trim(text, ' '))) AS query_key, sha256(concat(coalesce(library_id, ''), '|', coalesce(version, ''), '|', coalesce(text, ''))) AS entry_hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, _DOCS).select("doc_id", H.short_sha(t).alias("content_hash"), H.query_key(t).alias("query_key"), H.entry_hash(F.col("library_id"), F.col("version"), t).alias("entry_hash"))


@query()
def content_xxh64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _DOCS).select("doc_id", H.xxh64_hex("text").alias("content_hash"))


_SCORES = {k: f"CASE WHEN content IS NULL THEN 0.0 ELSE least(1.0, {_weighted('lower(content)', w)} / (length(content) / 1000 + 1)) END" for k, w in P.LANGUAGE_WEIGHTS.items()}


@query(
    "WITH s AS (SELECT entry_id, " + ", ".join(f"{v} AS s_{k}" for k, v in _SCORES.items()) + " FROM documentation_entry) SELECT entry_id, CASE WHEN greatest("
    + ", ".join(f"s_{k}" for k in _SCORES) + ") <= 0 THEN NULL " + " ".join(f"WHEN s_{k} = greatest({', '.join(f's_{j}' for j in _SCORES)}) THEN '{k}'" for k in _SCORES)
    + f" END AS code_language, round(greatest({', '.join(f's_{k}' for k in _SCORES)}), 6) AS score FROM s"
)
def code_languages(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    scores = {k: X.language_score(c, k) for k in P.LANGUAGE_WEIGHTS}
    rows = table(spark, d, _ENTRIES).select("entry_id", *[s.alias(k) for k, s in scores.items()])
    cols = {k: F.col(k) for k in scores}
    return rows.select("entry_id", X.best_of(cols, F.lit(None).cast("string")).alias("code_language"), F.round(F.greatest(*cols.values()), 6).alias("score"))


_TYPES = {k: f"coalesce({_weighted('lower(content)', w)}, 0.0)" for k, w in P.CONTENT_TYPE_WEIGHTS.items()}


@query(
    "WITH s AS (SELECT entry_id, " + ", ".join(f"{v} AS s_{k}" for k, v in _TYPES.items()) + " FROM documentation_entry), t AS (SELECT entry_id, CASE WHEN greatest("
    + ", ".join(f"s_{k}" for k in _TYPES) + ") <= 0 THEN 'documentation' " + " ".join(f"WHEN s_{k} = greatest({', '.join(f's_{j}' for j in _TYPES)}) THEN '{k}'" for k in _TYPES)
    + " END AS content_type FROM s) SELECT entry_id, content_type, CASE content_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.DOC_TYPES.items()) + " ELSE 'reference' END AS doc_type FROM t"
)
def content_types(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    rows = table(spark, d, _ENTRIES).select("entry_id", *[X.weighted_score(c, w).alias(k) for k, w in P.CONTENT_TYPE_WEIGHTS.items()])
    out = rows.select("entry_id", X.best_of({k: F.col(k) for k in P.CONTENT_TYPE_WEIGHTS}, F.lit("documentation")).alias("content_type"))
    return out.withColumn("doc_type", X.doc_type(F.col("content_type")))


def _hits(kind: str) -> str:
    return "(" + " + ".join(f"regexp_matches(lower(text), {_q(p)})::int" for p in P.SECTION_TYPES[kind]) + ")"


_LEVELS = " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(doc_type, '')), '{k}')" for k in keys) + f" THEN {n}" for n, keys in P.HIERARCHY)


@query(
    f"""SELECT doc_id, CASE WHEN {_hits('code')} >= 1 THEN 'code' WHEN {_hits('api')} >= 2 THEN 'api' WHEN {_hits('example')} >= 2 THEN 'example' ELSE 'text' END AS section_type,
    (CASE {_LEVELS} WHEN regexp_matches(text, '(^|\n)# ') THEN 0 WHEN regexp_matches(text, '(^|\n)## ') THEN 1 WHEN regexp_matches(text, '(^|\n)### ') THEN 2 ELSE 2 END)::int AS hierarchy FROM documents"""
)
def section_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _DOCS).select("doc_id", X.section_type(F.col("text")).alias("section_type"), X.hierarchy_level(F.col("doc_type"), F.col("text")).alias("hierarchy"))


@query("SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, {_q(p)}), false) AS {k}" for k, p in P.FEATURES.items()) + " FROM documents")
def text_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _DOCS).select("doc_id", *[X.feature(F.col("text"), k).alias(k) for k in P.FEATURES])


@query(
    "SELECT entry_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(content), {_q(f'(^|[^a-z0-9_])({p})($|[^a-z0-9_])')}) THEN '{k}' END" for k, p in P.TECHNOLOGIES.items())
    + "], lambda x: x IS NOT NULL), ',') AS technologies FROM documentation_entry"
)
def technology_mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _ENTRIES).select("entry_id", F.array_join(X.technologies(F.col("content")), ",").alias("technologies"))


_TERMS = " + ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)})" for w in P.TECHNICAL_WORDS)
_SHAPES = " + ".join(_count("lower(text)", p) for p in P.CODE_SHAPES)
_COMPLEX = f"""coalesce(least(1.0::double, CASE WHEN {_WORDS} > 0 THEN least(0.3::double, ({_TERMS})::double / {_WORDS} * 10) ELSE 0.0 END
    + least(0.4::double, ({_SHAPES})::double / 20) + least(0.3::double, {_count('text', 'GET|POST|PUT|DELETE|PATCH')}::double / 10)), 0.0)"""


@query(f"SELECT doc_id, round({_COMPLEX}, 6) AS complexity, CASE WHEN {_COMPLEX} < 0.3 THEN 'beginner' WHEN {_COMPLEX} < 0.7 THEN 'intermediate' ELSE 'advanced' END AS depth FROM documents")
def text_complexity(spark: SparkSession, d: str) -> DataFrame:
    score = X.complexity(F.col("text"))
    return table(spark, d, _DOCS).select("doc_id", F.round(score, 6).alias("complexity"), X.technical_depth(score).alias("depth"))


_PARTS = r"len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '[ \t\n\r\f]+', '', 'g') <> ''))"
_CLEAR = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 0.1::double ELSE 0 END" for w in P.CLARITY)
_READ = f"""CASE WHEN {_WORDS} = 0 THEN 0.0 WHEN {_PARTS} = 0 THEN 0.5 ELSE least(1.0::double,
    (CASE WHEN {_WORDS} / {_PARTS} BETWEEN 5 AND 20 THEN 1.0::double WHEN {_WORDS} / {_PARTS} < 5 THEN 0.6::double ELSE greatest(0.2::double, 1.0 - ({_WORDS} / {_PARTS} - 20) / 50) END) * 0.5
    + (CASE WHEN contains(text, chr(10) || chr(10)) THEN 0.3::double ELSE 0 END) + (CASE WHEN regexp_matches(text, '(^|\n)#+ ') THEN 0.3::double ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '(^|\n)(\\* |[0-9]+\\. )') THEN 0.2::double ELSE 0 END) + least(0.2::double, {_CLEAR})) END"""
_COMPLETE = "coalesce(least(1.0::double, (CASE WHEN length(text) > 1000 THEN 0.5::double WHEN length(text) > 500 THEN 0.4::double WHEN length(text) > 100 THEN 0.2::double ELSE 0 END) + " + " + ".join(f"CASE WHEN regexp_matches(lower(text), {_q(p)}) THEN 0.1::double ELSE 0 END" for p in P.PARTS) + "), 0.0)"
_FEATURE_W = {"has_code_examples": 0.3, "has_api_references": 0.2, "has_installation_instructions": 0.2, "has_configuration_details": 0.1}
_USE = "coalesce(least(1.0::double, " + " + ".join(f"CASE WHEN coalesce(regexp_matches(text, {_q(P.FEATURES[k])}), false) THEN {w}::double ELSE 0 END" for k, w in _FEATURE_W.items()) + " + least(0.2::double, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 0.05::double ELSE 0 END" for w in P.PRACTICAL) + ")), 0.0)"


@query(f"SELECT doc_id, round({_READ}, 6) AS readability, round({_COMPLETE}, 6) AS completeness, round({_USE}, 6) AS usefulness FROM documents")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, _DOCS).select("doc_id", F.round(X.readability(t), 6).alias("readability"), F.round(X.completeness(t), 6).alias("completeness"), F.round(X.usefulness(t), 6).alias("usefulness"))


_STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
_KEY_STOP = ", ".join(f"'{w}'" for w in P.KEYWORD_STOP_WORDS)
_KEYS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN ({_KEY_STOP}))))"


@query(f"SELECT entry_id, array_to_string({_KEYS.format('title')}, ' ') AS keywords FROM documentation_entry")
def title_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _ENTRIES).select("entry_id", F.array_join(X.keywords(F.col("title")), " ").alias("keywords"))


@query(
    f"""WITH k AS (SELECT entry_id, {_KEYS.format('title')} AS a, {_KEYS.format('description')} AS b FROM documentation_entry)
    SELECT entry_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) AS similarity FROM k"""
)
def title_description_likeness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _ENTRIES).select("entry_id", F.round(X.jaccard(X.keywords(F.col("title")), X.keywords(F.col("description"))), 6).alias("similarity"))


def _comparable_sql(c: str) -> str:
    out = rf"concat(' ', trim(regexp_replace(lower(coalesce({c}, '')), '[ \t\n\r\f]+', ' ', 'g')), ' ')"
    for mark in ("```", "<code>", "</code>"):
        out = f"replace({out}, '{mark}', '')"
    for old, new in (*P.ABBREVIATIONS, *P.SYNONYMS):
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"array_to_string(list_filter(string_split({out}, ' '), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ')"


@query(f"SELECT entry_id, md5({_comparable_sql('description')}) AS comparable FROM documentation_entry")
def comparable_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _ENTRIES).select("entry_id", F.md5(X.comparable(F.col("description"))).alias("comparable"))


@query(r"""WITH s AS (SELECT library_id, regexp_replace(trim(coalesce(library_id, '')), '[<>:"/\\|?*]+', '_', 'g') AS x FROM library_info),
    t AS (SELECT library_id, regexp_replace(regexp_replace(regexp_replace(x, '\.{2,}', '.', 'g'), '_{2,}', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g') AS x FROM s)
    SELECT library_id, CASE WHEN upper(x) IN ('CON', 'PRN', 'AUX', 'NUL') THEN x || '_lib' WHEN x = '' THEN 'unknown_library' WHEN length(x) > 100 THEN left(x, 80) || '_' || left(md5(x), 8) ELSE x END AS folder FROM t""")
def library_folders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "library_info").select("library_id", X.sanitized_id(F.col("library_id")).alias("folder"))


@query("""SELECT id, CASE WHEN star_count IS NULL OR star_count = 0 THEN '-' WHEN star_count >= 1000000 THEN (star_count // 1000000)::varchar || '.' || (star_count // 100000 % 10)::varchar || 'M'
    WHEN star_count >= 1000 THEN (star_count // 1000)::varchar || '.' || (star_count // 100 % 10)::varchar || 'K' ELSE star_count::varchar END AS stars FROM document_embedding""")
def compact_stars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _EMB).select("id", X.compact_number(F.col("star_count")).alias("stars"))


@query("WITH j AS (SELECT job_id, lower(error_message) AS m FROM ingestion_job WHERE error_message IS NOT NULL UNION ALL SELECT entry_id, lower(content) FROM documentation_entry WHERE content IS NOT NULL), k AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(m, '{p}') THEN '{k}'" for k, p in P.ERROR_KINDS) + " ELSE 'unknown' END AS kind FROM j) SELECT kind, count(*) AS n, round(count(*)::double / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY kind")
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    from quillgrid.operators.statistics import value_shares

    messages = table(spark, d, "ingestion_job").select("error_message").union(table(spark, d, _ENTRIES).select("content"))  # contents stand for messages of other kinds
    rows = messages.where("error_message is not null").select(X.error_kind(F.col("error_message")).alias("kind"))
    return value_shares(rows, "kind").select("kind", "n", F.round("share", 6).alias("share"))


@query("""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 10 AND NOT regexp_matches(x, '^[=#-]'))[1] AS f FROM documents)
    SELECT doc_id, CASE WHEN length(f) > 100 THEN left(f, 100) || '...' ELSE f END AS title FROM t""")
def first_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _DOCS).select("doc_id", X.first_line_title(F.col("text")).alias("title"))


@query("SELECT entry_id, regexp_replace(title, '(?i)(shell)', '<em>\\1</em>', 'g') AS title FROM documentation_entry WHERE contains(lower(title), 'shell')")
def highlighted_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, _ENTRIES).where(F.lower("title").contains("shell")).select("entry_id", X.highlighted(F.col("title"), "shell").alias("title"))


_W = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 199) // 200)) AS i FROM w)
    SELECT doc_id, i::int AS chunk_index, array_to_string(w[i * 200 + 1 : i * 200 + 200], ' ') AS content FROM c""")
def chunks_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, d, _DOCS), "doc_id", "text", 200)


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL), v AS (SELECT * FROM w WHERE len(w) > 0),
    c AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 200) / 160.0))::bigint)) AS i FROM v)
    SELECT doc_id, i::int AS chunk_index, array_to_string(w[i * 160 + 1 : i * 160 + 200], ' ') AS content FROM c""")
def chunks_strided(spark: SparkSession, d: str) -> DataFrame:
    return chunking.strided_chunks(table(spark, d, _DOCS), "doc_id", "text", 200, 40)


@query()
def chunks_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, _DOCS), "doc_id", "text")


@query("""SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id, count(*) OVER (PARTITION BY library_id, version) AS total,
    round(CASE WHEN sum(coalesce(length(content), 0)) OVER (PARTITION BY library_id, version) > 0 THEN coalesce(length(content), 0)::double / sum(coalesce(length(content), 0)) OVER (PARTITION BY library_id, version) ELSE 0 END, 6) AS relative_size
    FROM (SELECT DISTINCT id, library_id, version, chunk_index, content FROM document_embedding) WINDOW w AS (PARTITION BY library_id, version ORDER BY chunk_index NULLS FIRST, id)""")
def chunk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, _EMB).select("id", "library_id", "version", "chunk_index", "content").distinct()
    rows = rows.withColumn("doc", F.struct("library_id", "version")).withColumn("place", F.struct("chunk_index", "id"))
    out = chunking.with_neighbours(rows, "doc", "place", "id", X.zero_if_null(F.length("content")))
    return out.select("id", "previous_id", "next_id", "total", F.round("relative_size", 6).alias("relative_size"))


def _field(label: str) -> str:
    others = "|".join(documents.FIELDS)
    return f"nullif(trim(regexp_extract(content, '(?is)(?:^|\\n){label}:[ \\t]*(.*?)(?:\\n(?:{others}):|\\z)', 1), ' ' || chr(9) || chr(10) || chr(13)), '')"


@query("SELECT entry_id, " + ", ".join(f"lower({_field(f)}) AS language" if f == "LANGUAGE" else f"{_field(f)} AS {f.lower()}" for f in documents.FIELDS) + f" FROM documentation_entry WHERE regexp_matches(content, '(?i)(^|\\n)({'|'.join(documents.FIELDS)}):')")
def entry_fields(spark: SparkSession, d: str) -> DataFrame:
    return documents.entry_fields(table(spark, d, _ENTRIES), "entry_id", "content")


_OWN = ", ".join(f"'{k}'" for k in documents.METADATA_KEYS)
_STEP = "(?:\\.(?:\"[^\"]*\"|[^.\\[]+)|\\[[0-9]+\\])"


@query(f"""WITH c AS (SELECT entry_id, content FROM documentation_entry WHERE entry_id IS NOT NULL AND json_valid(content) AND json_type(content) IN ('OBJECT', 'ARRAY')),
    s AS (SELECT c.entry_id AS doc_id, t.fullkey AS k, t.atom ->> '$' AS content FROM c, json_tree(c.content) AS t WHERE t.type = 'VARCHAR')
    SELECT doc_id, replace(CASE WHEN k LIKE '$.%' THEN substr(k, 3) ELSE substr(k, 2) END, '"', '') AS name, len(regexp_extract_all(k, '{_STEP}'))::int - 1 AS level, content FROM s
    WHERE trim(content) <> '' AND lower(regexp_extract(k, '^\\$\\."?([^".\\[]+)', 1)) NOT IN ({_OWN})""")
def json_strings(spark: SparkSession, d: str) -> DataFrame:
    """Every string of the contents that are JSON, at any depth, with its path."""
    rows = table(spark, d, _ENTRIES).where(F.try_parse_json("content").isNotNull() & F.col("content").rlike(r"^\s*[\[{]"))
    return documents.sections(rows, "entry_id", "content")


@query()
def json_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, _ENTRIES).where(F.col("content").rlike(r"^\s*[\[{]"))
    return documents.section_facts(documents.sections(rows, "entry_id", "content"))


@query("""WITH m AS (SELECT metadata FROM ingestion_job WHERE metadata IS NOT NULL UNION ALL SELECT content FROM documentation_entry WHERE content IS NOT NULL), k AS (SELECT CASE WHEN ltrim(metadata) LIKE '{%' AND json_valid(metadata) THEN json_keys(metadata) END AS ks FROM m)
    SELECT CASE WHEN ks IS NULL THEN 'raw_text' WHEN len(list_intersect(ks, ['contexts', 'library_info', 'documentation_sections', 'total_tokens'])) >= 2 THEN 'tool_output' WHEN len(list_intersect(ks, ['name', 'version', 'description', 'installation', 'api_reference'])) >= 3 THEN 'standard_library'
    WHEN len(list_intersect(ks, ['content', 'documentation', 'text', 'body', 'readme', 'docs', 'sections', 'title'])) >= 1 THEN 'generic_documentation' ELSE 'unknown' END AS shape, count(*) AS n FROM k GROUP BY 1""")
def document_shapes(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "ingestion_job").select("metadata").union(table(spark, d, _ENTRIES).select("content")).where("metadata is not null")
    rows = texts.select(documents.document_shape(F.col("metadata")).alias("shape"))
    return rows.groupBy("shape").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return documents.json_members(table(spark, d, "events"), "event_id", "props", {"k": ("$.k", "bigint")})


@query("SELECT DISTINCT job_id, CAST(json_extract(metadata, '$.star_count') AS BIGINT) AS stars, round(CAST(json_extract(metadata, '$.trust_score') AS DOUBLE), 6) AS trust, json_extract_string(metadata, '$.category') AS category FROM ingestion_job")
def job_metadata(spark: SparkSession, d: str) -> DataFrame:
    out = documents.json_members(table(spark, d, "ingestion_job"), "job_id", "metadata", {"stars": ("$.star_count", "bigint"), "trust": ("$.trust_score", "double"), "category": ("$.category", "string")})
    return out.withColumn("trust", F.round("trust", 6)).distinct()
