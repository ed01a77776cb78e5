"""Search queries over vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgrid.functions import vectors as V
from quillgrid.operators import search as S
from quillgrid.operators.enrich import boosted
from quillgrid.operators.filters import apply_filter
from quillgrid.plans.registry import query, table

_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
TERMS = ["session", "cookie", "gradient", "invoice"]
TARGET_RECALL = 0.97
_indexes: dict[tuple[str, str], S.Postings] = {}


def _postings(spark: SparkSession, d: str) -> S.Postings:
    """The documents' inverted index, built once for each application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = S.Postings(table(spark, d, "documents"))
    return _indexes[key]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _query_vector(vectors: DataFrame, vec_id: int) -> list[float]:
    return vectors.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


@query(
    f"""WITH s AS (SELECT a.vec_id, a.label, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE a.label >= 0),
    t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)
    SELECT vec_id, label, score, rank::int AS rank, round(least(1.0, score * pow(1.1, 1)), 6) AS relevance,
    concat_ws('; ', CASE WHEN score >= 0.8 THEN 'high similarity' WHEN score >= 0.6 THEN 'good similarity' WHEN score >= 0.4 THEN 'moderate similarity' END, 'matches label') AS reasons FROM t"""
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    top = S.top_k(vectors, _query_vector(vectors, 0), 10, {"label": {"gte": 0}}).withColumn("score", F.round("score", 6))
    score = F.col("score")
    none = F.lit(None).cast("double")
    return top.select("vec_id", "label", "score", "rank", F.round(S.relevance(score, F.lit(1), none, none), 6).alias("relevance"), F.concat_ws("; ", S.match_reasons(score, {"label": F.lit(True)})).alias("reasons"))


@query(f"WITH s AS (SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b WHERE a.label IN (1, 2, 3) AND {_COS} >= 0.1) SELECT vec_id, score, (row_number() OVER (ORDER BY score DESC, vec_id))::int AS rank FROM s QUALIFY rank <= 20")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    top = S.top_k(vectors, _query_vector(vectors, 7), 20, {"label": [1, 2, 3]}, threshold=0.1)
    return top.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH s AS (SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b WHERE a.vec_id <> 3) SELECT vec_id, score, (row_number() OVER (ORDER BY score DESC, vec_id))::int AS rank FROM s QUALIFY rank <= 10")
def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    return S.more_like_this(_vectors(spark, d), 3, 10).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS match_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, match_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id))::int AS rank FROM s QUALIFY rank <= 10"""
)
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    out = S.top_k_batch(vectors.where("vec_id % 20 = 0"), vectors, 10)
    return out.withColumn("score", F.round("score", 6))


@query()
def vector_topk_approximate(spark: SparkSession, d: str) -> DataFrame:
    return _approximate(spark, d)[0]


def _approximate(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """(results, exact index rows, probes): searched through the cells of an index, as many as the target recall takes."""
    vectors = _vectors(spark, d)
    asked, index = vectors.where("vec_id % 20 = 0"), S.CellIndex(vectors)
    probes = index.tune_probes(asked, 10, TARGET_RECALL)
    return index.search(asked, 10, probes), index.read(), probes


@query()
def vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of vector_topk_approximate against all true matches of all its queries, with cells and probes."""
    vectors = _vectors(spark, d)
    found, rows, probes = _approximate(spark, d)
    out = S.recall_of(found, S.top_k_batch(vectors.where("vec_id % 20 = 0"), vectors, 10))
    return out.withColumn("probes", F.lit(probes)).join(rows.agg(F.countDistinct("cell").alias("cells")))


@query("SELECT doc_id, lang, 0.0::double AS score FROM documents WHERE lang = 'en' AND n_chars >= 200 AND n_chars < 2000 ORDER BY doc_id LIMIT 50")
def metadata_search(spark: SparkSession, d: str) -> DataFrame:
    return S.search_by_metadata(table(spark, d, "documents"), {"lang": "en", "n_chars": {"gte": 200, "lt": 2000}}, 50, "doc_id").select("doc_id", "lang", "score")


@query("SELECT doc_type, count(*) AS n FROM document_embedding WHERE programming_language IN ('python', 'py') AND trust_score >= 5 AND indexed_at >= TIMESTAMP '2025-10-15 00:00:00' GROUP BY doc_type")
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_embedding")
    kept = apply_filter(rows, {"programming_language": ["python", "py"], "trust_score": {"gte": 5}}).where(F.col("indexed_at") >= F.lit("2025-10-15 00:00:00").cast("timestamp_ntz"))
    return kept.groupBy("doc_type").agg(F.count("*").alias("n"))


@query("SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension' WHEN sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) < 0.1 OR sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) > 10 THEN 'norm' END AS problem, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) AS length FROM embeddings")
def vector_problems(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return _vectors(spark, d).select("vec_id", V.vector_problem(v, 64).alias("problem"), F.round(V.norm(v), 6).alias("length"))


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_DF = ", ".join(f"sum((tf{i} > 0)::int) AS df{i}" for i in range(len(TERMS)))
_BM = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / m))" for i in range(len(TERMS)))
_BM25 = f"""t AS (SELECT doc_id, {_TOK} AS w FROM documents), c AS (SELECT doc_id, len(w) AS l, {_TF} FROM t), g AS (SELECT count(*)::double AS n, avg(l) AS m, {_DF} FROM c),
    kw AS (SELECT doc_id, {_BM} AS score FROM c, g WHERE greatest(tf0, tf1, tf2, tf3) > 0)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM kw")
def keyword_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).bm25(TERMS).select("doc_id", F.round("score", 6).alias("score"))


_SEM = f"sem AS (SELECT a.vec_id AS doc_id, {_COS} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b WHERE {_COS} >= 0.2)"


@query(f"WITH {_BM25}, {_SEM}, m AS (SELECT max(score) AS top FROM kw) SELECT coalesce(s.doc_id, k.doc_id) AS doc_id, round(coalesce(s.score, 0) * 0.7 + coalesce(k.score / m.top, 0) * 0.3, 6) AS score FROM sem s FULL JOIN kw k USING (doc_id), m")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    semantic, keyword = _sides(spark, d)
    return S.fuse_weighted(semantic, keyword).select("doc_id", F.round("score", 6).alias("score"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = _vectors(spark, d)
    semantic = S.scored(vectors.select("vec_id", "embedding"), _query_vector(vectors, 1)).select(F.col("vec_id").alias("doc_id"), "score").where("score >= 0.2")
    return semantic, _postings(spark, d).bm25(TERMS)


@query(f"""WITH {_BM25}, {_SEM}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sem QUALIFY rank <= 100
    UNION ALL SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM kw QUALIFY rank <= 100) SELECT doc_id, round(sum(1.0::double / (60 + rank)), 6) AS score FROM r GROUP BY doc_id""")
def hybrid_ranks(spark: SparkSession, d: str) -> DataFrame:
    def top(df: DataFrame) -> DataFrame:
        best = df.select("doc_id", F.round("score", 6).alias("s")).orderBy(F.desc("s"), "doc_id").limit(100)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "doc_id")))  # 100 rows

    return S.fuse_ranks([top(x) for x in _sides(spark, d)]).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT 'doc_type' AS field, coalesce(doc_type, '(none)') AS value, count(*) AS n FROM document_embedding GROUP BY 1, 2 UNION ALL
    SELECT 'programming_language', coalesce(programming_language, '(none)'), count(*) FROM document_embedding GROUP BY 1, 2 UNION ALL SELECT 'section', coalesce(section, '(none)'), count(*) FROM document_embedding GROUP BY 1, 2""")
def facets(spark: SparkSession, d: str) -> DataFrame:
    return S.facet_counts(table(spark, d, "document_embedding"), ["doc_type", "programming_language", "section"])


@query(
    f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS match_id, a.label = b.label AS good, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank, sum(good::int) OVER (PARTITION BY query_id) AS n FROM s),
    k AS (SELECT query_id, n, sum((good AND rank <= 10)::int) AS hits, sum(CASE WHEN good AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN good AND rank <= 10 THEN rank END) AS first FROM r WHERE n > 0 GROUP BY 1, 2)
    SELECT query_id, round(hits::double / n, 6) AS recall, round(hits / 10.0::double, 6) AS precision, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(n, 10)::bigint) t(i)), 6) AS ndcg, round(coalesce(1.0::double / first, 0), 6) AS mrr FROM k"""
)
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    asked = vectors.where("vec_id % 20 = 0")
    results = S.top_k_batch(asked, vectors, 10)
    rel = asked.select(F.col("vec_id").alias("query_id"), "label").join(vectors.select(F.col("vec_id").alias("match_id"), "label"), "label").where("query_id <> match_id").select("query_id", "match_id", F.lit(1.0).alias("gain"))
    out = S.retrieval_quality(results, rel, 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "mrr")])


@query("SELECT name, max(stars) AS stars FROM library_info WHERE starts_with(lower(name), 'tr') GROUP BY name ORDER BY stars DESC NULLS LAST, name LIMIT 10")
def name_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return S.suggestions(table(spark, d, "library_info"), "name", "tr", "stars", 10)


@query("SELECT library_id, (CASE WHEN contains(lower(name), 'flow') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(coalesce(description, '')), 'flow') THEN 0.3 ELSE 0 END)::double AS relevance, trust_score FROM library_info WHERE contains(lower(name), 'flow') OR contains(lower(coalesce(description, '')), 'flow')")
def library_search(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda c, w: F.when(F.lower(F.coalesce(F.col(c), F.lit(""))).contains("flow"), w).otherwise(0.0)
    return table(spark, d, "library_info").select("library_id", (hit("name", 0.5) + hit("description", 0.3)).alias("relevance"), "trust_score").where("relevance > 0")


_LIB = "li AS (SELECT d.doc_id, l.trust_score AS trust, l.stars, date_diff('day', d.fetched_at::date, DATE '2026-09-01') AS age FROM documents d LEFT JOIN library_info l USING (library_id))"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, trust, stars, age in days) of each document by its library."""
    info = table(spark, d, "library_info").select("library_id", F.col("trust_score").alias("trust"), "stars")
    age = F.datediff(F.lit("2026-09-01").cast("date"), F.col("fetched_at").cast("date"))
    return table(spark, d, "documents").select("doc_id", "library_id", age.alias("age")).join(info, "library_id", "left").drop("library_id")


_TERM_LIST = ", ".join(f"'{t}'" for t in TERMS)


@query(f"WITH {_SEM}, t AS (SELECT doc_id, len(list_intersect(list_distinct({_TOK}), [{_TERM_LIST}])) / {len(TERMS)}.0::double AS kw FROM documents) SELECT doc_id, round(sem.score * 0.7 + coalesce(t.kw, 0) * 0.3, 6) AS score FROM sem LEFT JOIN t USING (doc_id)")
def hybrid_words(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse_by_words(_sides(spark, d)[0], table(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, {_SEM}, {_LIB}, f AS (SELECT sem.doc_id, sem.score * 0.7 + coalesce(kw.score, 0) * 0.3 AS s FROM sem LEFT JOIN kw USING (doc_id))
    SELECT f.doc_id, round(s * CASE WHEN trust >= 9 THEN 1.3 WHEN trust >= 7 THEN 1.15 WHEN trust >= 5 THEN 1.05 ELSE 1 END * CASE WHEN age < 30 THEN 1.05 ELSE 1 END, 6) AS score FROM f LEFT JOIN li ON f.doc_id = li.doc_id""")
def hybrid_raw_boosted(spark: SparkSession, d: str) -> DataFrame:
    semantic, keyword = _sides(spark, d)
    both = S.fuse_raw(semantic, keyword).join(_facts(spark, d), "doc_id", "left")
    none = F.lit(None).cast("string")
    return both.select("doc_id", F.round(boosted(F.col("score"), F.col("trust"), none, none, "", "") * F.when(F.col("age") < 30, 1.05).otherwise(1.0), 6).alias("score"))


@query(f"WITH {_BM25}, {_SEM} SELECT coalesce(s.doc_id, k.doc_id) AS doc_id, round(CASE WHEN s.doc_id IS NULL THEN k.score WHEN k.doc_id IS NULL THEN s.score ELSE s.score * 0.6 + k.score * 0.4 END * CASE WHEN d.lang = 'en' THEN 1.2 ELSE 1 END * CASE WHEN d.doc_type = 'api' THEN 1.3 ELSE 1 END, 6) AS score FROM sem s FULL JOIN kw k USING (doc_id) LEFT JOIN documents d ON d.doc_id = coalesce(s.doc_id, k.doc_id)")
def hybrid_in_both(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "doc_type")
    both = S.fuse_both(*_sides(spark, d)).join(docs, "doc_id", "left")
    return both.select("doc_id", F.round(F.col("score") * F.when(F.col("lang") == "en", 1.2).otherwise(1.0) * F.when(F.col("doc_type") == "api", 1.3).otherwise(1.0), 6).alias("score"))


@query(f"""WITH {_BM25}, {_SEM}, {_LIB}, a AS (SELECT doc_id, (score - (SELECT min(score) FROM sem)) / (SELECT max(score) - min(score) FROM sem) AS s FROM sem), b AS (SELECT doc_id, (score - (SELECT min(score) FROM kw)) / (SELECT max(score) - min(score) FROM kw) AS k FROM kw),
    f AS (SELECT doc_id, coalesce(s, 0) * 0.7 + coalesce(k, 0) * 0.3 AS x FROM a FULL JOIN b USING (doc_id)), y AS (SELECT f.doc_id, x * (1 + coalesce(CASE WHEN trust > 8 THEN 0.2 WHEN trust > 6 THEN 0.1 END, 0) + coalesce(CASE WHEN age < 30 THEN 0.1 WHEN age < 180 THEN 0.05 END, 0) + coalesce(CASE WHEN stars > 10000 THEN 0.15 WHEN stars > 1000 THEN 0.1 WHEN stars > 100 THEN 0.05 END, 0)) AS y FROM f LEFT JOIN li ON f.doc_id = li.doc_id)
    SELECT doc_id, round(y, 5) AS score FROM y WHERE y >= 0.1""")
def hybrid_popular(spark: SparkSession, d: str) -> DataFrame:
    semantic, keyword = (S.scaled(x) for x in _sides(spark, d))
    both = semantic.select("doc_id", F.col("score").alias("s")).join(keyword.select("doc_id", F.col("score").alias("k")), "doc_id", "full_outer")
    both = both.select("doc_id", (F.coalesce("s", F.lit(0.0)) * 0.7 + F.coalesce("k", F.lit(0.0)) * 0.3).alias("x")).join(_facts(spark, d), "doc_id", "left")
    return both.select("doc_id", F.round(S.popularity_boost(F.col("x"), F.col("trust"), F.col("age"), F.col("stars")), 5).alias("score"), S.popularity_boost(F.col("x"), F.col("trust"), F.col("age"), F.col("stars")).alias("y")).where("y >= 0.1").drop("y")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return apply_filter(_vectors(spark, d), {"vec_id": 7}).select("vec_id", "label")


@query("""WITH w(word) AS (VALUES ('flow'), ('data'), ('kit')), h AS (SELECT word, library_id, (CASE WHEN contains(lower(name), word) THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(coalesce(description, '')), word) THEN 0.3 ELSE 0 END)::double AS relevance, coalesce(trust_score, 0) AS trust, coalesce(stars, 0) AS stars FROM library_info, w)
    SELECT word, library_id, relevance, (row_number() OVER (PARTITION BY word ORDER BY relevance DESC, trust DESC, stars DESC, library_id))::int AS rank FROM h WHERE relevance > 0 QUALIFY rank <= 10""")
def library_search_batch(spark: SparkSession, d: str) -> DataFrame:
    """Three words at once; the limit is clamped to 1 .. 50."""
    words = spark.createDataFrame([("flow",), ("data",), ("kit",)], "word string")
    hit = lambda c, w: F.when(F.lower(F.coalesce(F.col(c), F.lit(""))).contains(F.col("word")), w).otherwise(0.0)
    rows = table(spark, d, "library_info").join(F.broadcast(words))  # three rows
    rows = rows.select("word", "library_id", (hit("name", 0.5) + hit("description", 0.3)).alias("relevance"), F.coalesce("trust_score", F.lit(0.0)).alias("trust"), F.coalesce("stars", F.lit(0)).alias("stars")).where("relevance > 0")
    order = Window.partitionBy("word").orderBy(F.desc("relevance"), F.desc("trust"), F.desc("stars"), "library_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= S.clamped(10)).select("word", "library_id", "relevance", "rank")
