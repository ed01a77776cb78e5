"""Queries over documents, entries and chunks: profiles, quality, shapes, payloads, near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.functions import patterns as P, text as X
from quillgrid.operators import chunking, dedup as D, documents as DOC, ordered, quality as Q
from quillgrid.plans.registry import query, table


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _n(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {_q(pattern)}))"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documentation_entry")


_VOTES = {k: "(" + " + ".join(_n("lower(coalesce(content, ''))", p) for p in ps) + ")" for k, ps in P.LANGUAGE_WEIGHTS.items()}


@query("WITH v AS (SELECT entry_id, " + ", ".join(f"{v} AS v_{k}" for k, v in _VOTES.items()) + ") SELECT entry_id, CASE ".replace(") SELECT", " FROM documentation_entry) SELECT") + " ".join(f"WHEN v_{k} > 0 AND v_{k} = greatest({', '.join(f'v_{j}' for j in _VOTES)}) THEN '{k}'" for k in _VOTES) + " END AS language FROM v")
def language_votes(spark: SparkSession, d: str) -> DataFrame:
    votes = _entries(spark, d).select("entry_id", *[X.language_votes(F.col("content"), k).alias(f"v_{k}") for k in P.LANGUAGE_WEIGHTS])
    return votes.select("entry_id", X.best_of({k: F.col(f"v_{k}") for k in P.LANGUAGE_WEIGHTS}, F.lit(None).cast("string")).alias("language"))


_TYPES = " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(content, '')), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in P.ENTRY_TYPES)


@query(f"SELECT entry_id, CASE WHEN contains(lower(coalesce(title, '')), 'code') THEN 'code_snippet' WHEN contains(lower(coalesce(title, '')), 'qa') THEN 'qa_section' WHEN contains(lower(coalesce(title, '')), 'example') THEN 'example' WHEN contains(lower(coalesce(title, '')), 'documentation') THEN 'documentation' WHEN contains(lower(coalesce(content, '')), '```') THEN 'code_snippet' {_TYPES} ELSE 'documentation' END AS entry_type FROM documentation_entry")
def entry_types(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("entry_id", X.entry_type(F.col("title"), F.lit(None).cast("string"), F.col("content")).alias("entry_type"))


_DOMAIN = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(name), '{p}')" for p in ps) + f" THEN '{k}'" for k, ps in P.NAME_DOMAINS.items()) + " ELSE 'general' END"


@query(f"SELECT library_id, {_DOMAIN} AS domain FROM library_info")
def name_profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "library_info").select("library_id", X.name_domain(F.col("name")).alias("domain"))


_TEMPLATES = ", ".join(f"('{k}', {i}, '{t}')" for k, ts in P.DOMAIN_CONTEXTS.items() for i, t in enumerate(ts))


@query(f"WITH t(domain, place, context) AS (VALUES {_TEMPLATES}) SELECT library_id, t.place::int AS place, name || ' ' || t.context AS context FROM (SELECT *, {_DOMAIN} AS dom FROM library_info) l JOIN t ON t.domain = l.dom WHERE name IS NOT NULL")
def library_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The contexts to ask for of each library by the domain of its name."""
    rows = [(k, i, t) for k, ts in P.DOMAIN_CONTEXTS.items() for i, t in enumerate(ts)]
    templates = spark.createDataFrame(rows, "domain string, place int, context string")
    own = table(spark, d, "library_info").where("name is not null").select("library_id", "name", X.name_domain(F.col("name")).alias("domain"))
    return own.join(F.broadcast(templates), "domain").select("library_id", "place", F.concat_ws(" ", "name", "context").alias("context"))  # a fixed table


_CODE = "(" + " + ".join(_n("coalesce(text, '')", p) for p in P.CODE_EXAMPLES) + ")"
_API = "(" + " + ".join(_n("coalesce(text, '')", p) for p in P.API_REFERENCES) + ")"


@query(f"SELECT doc_id, {_CODE}::int AS code_examples, {_API}::int AS api_references, (" + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in P.INSTALL_COMMANDS) + ") AS installs FROM documents")
def quality_counters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.code_examples(t).alias("code_examples"), X.api_references(t).alias("api_references"), X.has_installation(t).alias("installs"))


@query()
def quality_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return Q.quality_dimensions(_entries(spark, d), "entry_id", "content")


@query(r"""WITH c AS (SELECT id, content, (len(regexp_extract_all(content, '```')))::int AS f FROM (SELECT DISTINCT id, content FROM document_embedding WHERE content IS NOT NULL))
    SELECT id, round(CASE WHEN len(list_filter(regexp_split_to_array(content, '[ \t\n\r\f]+'), lambda w: w <> '')) = 0 THEN 0.0 ELSE least(1.0, 0.3 + CASE WHEN regexp_matches(content, '[.!?]') THEN 0.4 ELSE 0 END + CASE WHEN contains(content, chr(10) || chr(10)) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(content, '([.!?})]|```)\n?$') THEN 0.1 ELSE 0 END) END::double, 6) AS narrative,
    round(CASE WHEN len(list_filter(regexp_split_to_array(content, '[ \t\n\r\f]+'), lambda w: w <> '')) = 0 THEN 0.0 ELSE least(1.0, 0.3 + CASE WHEN regexp_matches(content, '(^|\n)\s*(def\s+\w+\([^)]*\):|class\s+\w+)') THEN 0.4 WHEN f > 0 AND f % 2 = 0 THEN 0.3 ELSE 0.1 END + CASE WHEN regexp_matches(content, '([.!?})]|```)\n?$') THEN 0.1 ELSE 0 END) END::double, 6) AS code FROM c""")
def chunk_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_embedding").where("content is not null").select("id", "content").distinct()
    score = lambda s: F.round(X.chunk_completeness(F.col("content"), F.lit(s)), 6)
    return rows.select("id", score("narrative").alias("narrative"), score("code_aware").alias("code"))


@query(r"""SELECT entry_id, round(0.5 + CASE WHEN language = 'python' THEN 0.2 ELSE 0 END + CASE WHEN entry_type = 'api' THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(content, '```|def \w+|function \w+|class \w+') THEN CASE WHEN len(regexp_extract_all(content, '```')) > 0 AND len(regexp_extract_all(content, '```')) % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(content, '(^|\n)(    |\t)') THEN 0.1 ELSE 0 END ELSE 0 END::double, 6) AS accuracy FROM documentation_entry WHERE content IS NOT NULL""")
def technical_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How well entries agree with what they claim, if they are taken for an API reference of python."""
    return _entries(spark, d).where("content is not null").select("entry_id", F.round(X.technical_accuracy(F.col("language"), F.lit("python"), F.lit("api_reference"), F.col("entry_type"), F.col("content")), 6).alias("accuracy"))


@query("""WITH j AS (SELECT entry_id, content::json AS j FROM documentation_entry WHERE json_valid(content) AND ltrim(content) LIKE '{%'), k AS (SELECT entry_id, unnest(json_keys(j)) AS k, j FROM j),
    v AS (SELECT entry_id, k, json_type(j, '$."' || k || '"') AS t, json_extract_string(j, '$."' || k || '"') AS s FROM k)
    SELECT entry_id, count(*) AS keys, sum((t = 'OBJECT')::int)::bigint AS nested, sum((contains(k, '_') AND k = lower(k))::int)::bigint AS snake, sum((regexp_matches(k[2:], '[A-Z]'))::int)::bigint AS camel, sum((t = 'VARCHAR' AND length(trim(s)) > 10)::int)::bigint AS populated FROM v GROUP BY 1""")
def json_key_metrics(spark: SparkSession, d: str) -> DataFrame:
    return DOC.key_metrics(_entries(spark, d), "entry_id", "content")


@query("""WITH e AS (SELECT id, library_id, version, doc_type, indexed_at, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS r, map_extract(metadata, 'language')[1] AS l, map_extract(metadata, 'section_type')[1] AS s FROM document_embedding WHERE id IS NOT NULL)
    SELECT id, coalesce(doc_type, '') AS doc_type, l AS language, s AS section_type, version AS version FROM e WHERE r = 1""")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The chunk's own map with the row's columns laid over it; the right side wins."""
    rows = table(spark, d, "document_embedding").where("id is not null")
    newest = rows.groupBy("id").agg(F.max_by(F.struct("metadata", "doc_type", "version"), "indexed_at").alias("r")).select("id", "r.*")
    m = DOC.merged_maps(F.col("metadata"), F.create_map(F.lit("doc_type"), F.coalesce("doc_type", F.lit("")), F.lit("version"), F.col("version")))
    return newest.select("id", *[m[k].alias(k) for k in ("doc_type", "language", "section_type", "version")])


@query("SELECT library_id, entry_id, (row_number() OVER (PARTITION BY library_id ORDER BY entry_id) - 1)::int AS place, coalesce(title, '') AS title FROM documentation_entry WHERE library_id IS NOT NULL AND entry_id IS NOT NULL")
def exploded_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that come as one JSON list for each run and library, one row for each with its place in the list."""
    rows = _entries(spark, d).where("library_id is not null and entry_id is not null").select("library_id", "entry_id", F.coalesce("title", F.lit("")).alias("title"))
    pages = rows.withColumn("page", F.pmod(F.xxhash64("entry_id"), F.lit(64)))  # a library's list comes in pages
    lists = pages.groupBy("library_id", "page").agg(F.to_json(F.array_sort(F.collect_list(F.struct("entry_id", "title")))).alias("entries"))
    back = DOC.exploded_list(lists, ["library_id"], "entries", "entry_id string, title string")
    return ordered.numbered(back, ["library_id"], ["entry_id"], "place").select("library_id", "entry_id", "place", "title")


@query("""WITH c AS (SELECT DISTINCT ON (id) id, library_id, version, chunk_index, total_chunks, programming_language, token_count, trust_score, content FROM (SELECT DISTINCT id, library_id, version, chunk_index, total_chunks, programming_language, token_count, trust_score, content, indexed_at FROM document_embedding WHERE id IS NOT NULL) ORDER BY id, indexed_at DESC)
    SELECT id, library_id, version, coalesce(programming_language, '') AS programming_language, coalesce(token_count, 0) AS token_count, coalesce(trust_score / 10, 0.5) AS quality, left(content, 200) AS preview, md5(content) AS content_hash, 'document' AS input_type FROM c WHERE content IS NOT NULL AND trim(content) <> ''""")
def embedding_requests(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as requests for embedding and as payloads of vectors: defaults filled in, previews cut."""
    rows = table(spark, d, "document_embedding").where("id is not null")
    columns = ("library_id", "version", "programming_language", "token_count", "trust_score", "content")
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*columns), "indexed_at").alias("r")).select("id", "r.*")
    return DOC.requests(newest.where(F.trim("content") != ""), "content")


@query()
def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text", F.lit("structured"))
    return chunking.with_analysis(rows)


@query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text", F.lit("sentences"))


@query("SELECT entry_id, left(trim(array_to_string(list_transform(string_split(content, chr(10))[2:5], lambda x: trim(x)), ' ')), 300) AS description FROM documentation_entry WHERE content IS NOT NULL")
def fallback_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).where("content is not null").select("entry_id", X.description_lines(F.col("content")).alias("description"))


_WORDS = "list_filter(regexp_split_to_array(lower(content), '[ \t\n\r\f]+'), lambda w: w <> '')"


@query(f"""WITH RECURSIVE v AS (SELECT entry_id, length(content) AS size, {_WORDS} AS v FROM documentation_entry WHERE content IS NOT NULL), s AS (SELECT entry_id, size, list_sort(list_distinct(list_transform(range(1, 1 + greatest(len(v) - 4, 1)), lambda i: array_to_string(v[i:i + 4], ' ')))) AS w FROM v WHERE len(v) > 0),
    c AS (SELECT w, min(entry_id) AS k FROM s GROUP BY 1), u AS (SELECT k, len(w) AS n, unnest(w) AS x FROM c), p AS (SELECT a.k AS a, b.k AS b, count(*)::double AS c, any_value(a.n + b.n) AS n FROM u a JOIN u b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2),
    e AS (SELECT a, b FROM p WHERE c / (n - c) >= 0.8 - 1e-9), r AS (SELECT k AS node, k AS reach FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
    g AS (SELECT node, min(reach) AS component FROM r GROUP BY node), m AS (SELECT s.entry_id, s.size, g.component FROM s JOIN c USING (w) JOIN g ON g.node = c.k),
    kept AS (SELECT entry_id FROM m QUALIFY row_number() OVER (PARTITION BY component ORDER BY size DESC, entry_id) = 1)
    SELECT entry_id FROM documentation_entry WHERE entry_id IN (FROM kept) OR entry_id NOT IN (SELECT entry_id FROM s)""")
def near_copies_merged(spark: SparkSession, d: str) -> DataFrame:
    """Entries after near copies of whole contents (0.8 of their runs of five words in common) have been merged into the
    longest."""
    rows = _entries(spark, d)
    sets = D.word_sets(rows, [], "entry_id", D.word_shingles(F.col("content")))
    groups = D.similar_groups(sets, D.similar_classes(sets, [], 0.8))
    return D.representatives(rows.select("entry_id", "content"), groups, "entry_id", F.length("content")).select("entry_id")


@query()
def entry_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Entries kept when, in order of their ids, they repeat no kept entry of their library by hash, title or words."""
    return D.entry_cascade(_entries(spark, d), "library_id", "entry_id").select("entry_id")


_BAG = "list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]{{2,}}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + "))"


@query(f"""WITH t AS (SELECT entry_id, {_BAG.format('title')} AS a, {_BAG.format('description')} AS b FROM documentation_entry), u AS (SELECT entry_id, unnest(list_distinct(list_concat(a, b))) AS w, a, b FROM t),
    f AS (SELECT entry_id, len(list_filter(a, lambda x: x = w)) AS fa, len(list_filter(b, lambda x: x = w)) AS fb FROM u), g AS (SELECT entry_id, fa * i AS x, fb * i AS y FROM (SELECT *, ln(3.0 / (1 + (fa > 0)::int + (fb > 0)::int)) + 1 AS i FROM f)),
    s AS (SELECT entry_id, sum(x * y) AS xy, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny FROM g GROUP BY 1) SELECT t.entry_id, round(coalesce(CASE WHEN nx > 0 AND ny > 0 THEN xy / (nx * ny) END, 0), 6) AS similarity FROM t LEFT JOIN s ON t.entry_id = s.entry_id""")
def title_description_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """How alike each title and description are, as a collection of two texts (tf-idf, cosine)."""
    return _entries(spark, d).select("entry_id", F.round(Q.pair_similarity(F.col("title"), F.col("description")), 6).alias("similarity"))
