"""Vector search, keyword search, fusion and ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.functions import vectors as V
from quillgrid.operators.filters import apply_filter
from quillgrid.plans.materialize import materialize, scratch_path


def _matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit rows) of the vectors of that size that have a length; values are read from the batch's buffer."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dimensions))
    size = np.diff(column.offsets.to_numpy())
    good = np.flatnonzero((size == dimensions) & ~np.asarray(column.is_null()))
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) if column.null_count == 0 else np.array([x for v in column.to_pylist() if v is not None for x in v], np.float64)
    begin = np.cumsum(np.where(np.asarray(column.is_null()), 0, size)) - np.where(np.asarray(column.is_null()), 0, size)
    x = values[begin[good][:, None] + np.arange(dimensions)[None, :]] if len(good) else np.zeros((0, dimensions))
    norm = np.sqrt((x * x).sum(1))
    real = np.flatnonzero((norm > 0) & np.isfinite(norm))
    return good[real], x[real] / norm[real][:, None]


def scored(vectors: DataFrame, query: list[float], k: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``score`` (cosine to one vector) in place of a column of that name, by a matrix product for each
    Arrow batch; rows without a score are left out. With ``k`` a batch passes on only its best k rows, ties by id."""
    q = np.array(query, np.float64)
    length = np.sqrt((q * q).sum())
    rows = vectors.drop("score")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not length:
                continue
            at, x = _matrix(batch.column(vector), len(q))
            s = x @ (q / length)
            if k is not None and len(at) > k:
                key = np.round(s, 6)
                least = -np.partition(-key, k - 1)[k - 1]
                near = np.flatnonzero(key >= least)
                order = sorted(near.tolist(), key=lambda i: (-key[i], batch.column(id_col)[int(at[i])].as_py()))[:k]
                at, s = at[order], s[order]
            picked = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(s, pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.where(F.col(id_col).isNotNull()).mapInArrow(run, f"{schema}, score double")


def top_k(vectors: DataFrame, query: list[float], k: int, filters: dict[str, Any] | None = None, threshold: float | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows most like one query vector, with ``score`` (cosine) and ``rank`` from 1; ties by id.

    The filter reaches the scan; only k rows leave each batch. Rows whose id or vector is null, of another size or of no
    length have no score and are left out.
    """
    rows = scored(apply_filter(vectors, filters), query, k, id_col, vector).withColumn("_key", F.round("score", 6))
    best = rows.orderBy(F.desc("_key"), F.col(id_col)).limit(k)
    best = best if threshold is None else best.where(F.col("score") >= threshold)
    order = Window.orderBy(F.desc("_key"), F.col(id_col))  # k rows
    return best.withColumn("rank", F.row_number().over(order)).drop("_key")


def more_like_this(vectors: DataFrame, vec_id: Any, k: int, filters: dict[str, Any] | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows most like a stored one, itself left out; empty where there is no such row."""
    found = vectors.where(F.col(id_col) == vec_id).select(vector).take(1)
    if not found or found[0][0] is None:
        return vectors.limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    return top_k(vectors.where(F.col(id_col) != vec_id), found[0][0], k, filters, None, id_col, vector)


#: Queries and rows of one block; a task scores a block of queries against a block of rows, slice by slice.
QUERY_BLOCK, ROW_BLOCK, ROW_SLICE = 1024, 65_536, 4096


def _block_scores(k: int):
    """Scores of one block of queries against one block of rows: the best k of each query.

    Rows are taken in slices, and each query keeps its best k so far, so memory doesn't depend on the block's rows.
    """

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        x = np.array(pdf["v"].tolist(), dtype=np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def score(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(rows):
            return pd.DataFrame({"query_id": [], "match_id": [], "score": []})
        rows = rows.sort_values("id", kind="stable")
        a, ids, own = unit(q), rows["id"].to_numpy(), q["id"].to_numpy()
        best_key = np.full((len(q), k), -1, np.int64)
        best_score = np.full((len(q), k), -np.inf)
        for at in range(0, len(rows), ROW_SLICE):
            part = rows.iloc[at : at + ROW_SLICE]
            s = a @ unit(part).T
            # rounded score first, then the place of the id: greater is better, and no two are equal
            key = (np.round((s + 2) * 1e6).astype(np.int64) << 22) | (len(rows) - 1 - np.arange(at, at + len(part)))[None, :]
            key[own[:, None] == ids[at : at + ROW_SLICE][None, :]] = -1
            key, s = np.concatenate([best_key, key], 1), np.concatenate([best_score, s], 1)
            top = np.argpartition(-key, k - 1, axis=1)[:, :k]
            best_key, best_score = np.take_along_axis(key, top, 1), np.take_along_axis(s, top, 1)
        good = best_key >= 0
        place = len(rows) - 1 - (best_key & ((1 << 22) - 1))
        return pd.DataFrame({"query_id": np.repeat(own, k)[good.ravel()], "match_id": ids[place[good]], "score": best_score[good]})

    return score


def _sound(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & (V.norm(F.col(vector)) > 0)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))


def top_k_batch(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, match_id, score, rank): for every query its ``k`` most alike rows, itself left out; exact.

    Queries and rows are dealt into blocks of a fixed size, so there are the more of them the more rows there are; a pair
    of blocks is one task of matrix products over slices that passes on only k rows for each query. A block holds fewer
    than 4 million rows.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    q, r = _sound(queries, id_col, vector), _sound(vectors, id_col, vector)
    many_q, many_r = blocks(queries, query_block), blocks(vectors, row_block)
    return ranked(_scored_blocks(_dealt(q, "qb", many_q, "rb", many_r), _dealt(r, "rb", many_r, "qb", many_q), ["qb", "rb"], k), k)


def _dealt(df: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
    """Rows in blocks by a hash of their id, once for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def _scored_blocks(q: DataFrame, r: DataFrame, keys: list[str], k: int) -> DataFrame:
    kind = q.schema["id"].dataType.simpleString()
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_block_scores(k), f"query_id {kind}, match_id {kind}, score double")


def clamped(limit: int, most: int = 50) -> int:
    """A limit brought between 1 and ``most``."""
    return max(1, min(most, limit))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The best k of each query by score, ties by id; Spark keeps k rows of a query in each task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.col("match_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows that centroids are fitted to at most, and queries that probes are tuned on.
FIT_SAMPLE, TUNE_QUERIES = 20_000, 200


def fit_cells(vectors: DataFrame, cells: int | None = None, sample: int = FIT_SAMPLE, rounds: int = 10, seed: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Unit centroids of an inverted index, fitted to at most ``sample`` rows (the ones with the smallest id hashes).

    Without a number there are as many cells as the root of the number of rows, from 8 to 4,096.
    """
    cells = cells or int(min(4096, max(8, np.sqrt(vectors.count()))))
    rows = _sound(vectors, id_col, vector).orderBy(F.xxhash64("id")).limit(sample).select("v").toPandas()
    x = np.array(rows["v"].tolist(), dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = np.stack([x[of == i].mean(0) if (of == i).any() else c[i] for i in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True) + 1e-12
    return c


def _nearest(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(centroids)  # cells * dimensions numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["v"].tolist(), dtype=np.float64)
                pdf["cells"] = list(np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32))
                yield pdf

    kind, values = df.schema["id"].dataType.simpleString(), df.schema["v"].dataType.simpleString()
    return df.select("id", "v").mapInPandas(run, f"id {kind}, v {values}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


class CellIndex:
    """An inverted index of vectors in the shared folder: every row once, in the cell of its nearest centroid, partitioned
    by cell, so a search opens the cells that its queries probe and no others."""

    def __init__(self, vectors: DataFrame, centroids: np.ndarray | None = None, id_col: str = "vec_id", vector: str = "embedding"):
        self.spark, self.centroids = vectors.sparkSession, fit_cells(vectors, id_col=id_col, vector=vector) if centroids is None else centroids
        self.path, self.id_col, self.vector = scratch_path(self.spark, "cells"), id_col, vector
        placed = _nearest(_sound(vectors, id_col, vector), self.centroids, 1)
        self.schema = placed.schema
        # a cell of very many rows is split over several tasks and files
        placed.hint("rebalance", F.col("cell")).sortWithinPartitions("cell").write.partitionBy("cell").parquet(self.path)
        sizes = self.read().groupBy("cell").agg(F.count("*").alias("n")).collect()  # one row for each cell, 4,096 at most
        self.blocks = {r["cell"]: -(-r["n"] // ROW_BLOCK) for r in sizes}

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, match_id, score, rank) from the ``probes`` cells nearest to each query; a cell of many rows is searched
        in blocks of ROW_BLOCK rows, and its queries in blocks of QUERY_BLOCK."""
        q = materialize(_nearest(_sound(queries, self.id_col, self.vector), self.centroids, probes), "probes")
        asked = {r["cell"]: -(-r["n"] // QUERY_BLOCK) for r in q.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
        touched = sorted(c for c in asked if c in self.blocks)
        rows = self.read().where(f"cell in ({', '.join(map(str, touched))})" if touched else "false")
        q = q.where(F.col("cell").isin(touched))
        number = lambda counts: F.element_at(F.map_from_arrays(F.lit(touched or [0]), F.lit([counts.get(c, 1) for c in touched] or [1])), F.col("cell"))
        own = lambda df, name, counts: df.withColumn(name, F.pmod(F.xxhash64("id"), number(counts)).cast("int"))
        every = lambda df, name, counts: df.withColumn(name, F.explode(F.sequence(F.lit(0), number(counts) - 1)))
        q, rows = every(own(q, "qb", asked), "rb", self.blocks), every(own(rows, "rb", self.blocks), "qb", asked)
        return ranked(_scored_blocks(q, rows, ["cell", "qb", "rb"], k), k)

    def tune_probes(self, queries: DataFrame, k: int, target: float = 0.95, most: int = TUNE_QUERIES) -> int:
        """The least number of probes that finds at least ``target`` of the true matches of at most ``most`` queries (the
        ones with the smallest id hashes)."""
        some = materialize(queries.orderBy(F.xxhash64(self.id_col)).limit(most), "tuning")
        every = self.read().select(F.col("id").alias(self.id_col), F.col("v").alias(self.vector))
        true = top_k_batch(some, every, k, self.id_col, self.vector).select("query_id", "match_id")
        in_cell = true.join(self.read().select(F.col("id").alias("match_id"), F.col("cell").alias("of")), "match_id")
        near = _nearest(_sound(some, self.id_col, self.vector), self.centroids, len(self.centroids)).groupBy("id").agg(F.collect_list("cell").alias("cells"))
        place = in_cell.join(near, in_cell["query_id"] == near["id"]).select(F.array_position("cells", F.col("of")).alias("place"))
        counts = sorted((r["place"], r["n"]) for r in place.groupBy("place").agg(F.count("*").alias("n")).collect())  # one row for each place
        total, held = sum(n for _, n in counts), 0
        for at, n in counts:
            held += n
            if held >= target * total:
                return int(at)
        return len(self.centroids)


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """(expected, found, recall) of results (query_id, match_id) against the true ones."""
    both = true.select("query_id", "match_id").join(found.select("query_id", "match_id", F.lit(1).alias("hit")), ["query_id", "match_id"], "left")
    return both.agg(F.count("*").alias("expected"), F.count("hit").alias("found")).withColumn("recall", F.try_divide(F.col("found"), F.col("expected")))


def search_by_metadata(df: DataFrame, filters: dict[str, Any], k: int, id_col: str) -> DataFrame:
    """The first ``k`` rows by id that pass the filters, with score 0.0."""
    return apply_filter(df, filters).withColumn("score", F.lit(0.0)).orderBy(id_col).limit(k)


def relevance(score: Column, matches: Column, trust: Column, days_old: Column) -> Column:
    """Score raised by filter matches (a tenth each), trust (up to a fifth) and recency (up to a tenth in a year), at most 1."""
    recency = F.greatest(F.lit(0.0), (365 - F.coalesce(days_old, F.lit(365))) / 365) * 0.1
    return F.least(F.lit(1.0), score * F.pow(F.lit(1.1), matches) * (1 + F.least(F.coalesce(trust, F.lit(0.0)) / 10, F.lit(0.2))) * (1 + recency))


def match_reasons(score: Column, matched: dict[str, Column]) -> Column:
    """Why a row was found: the band of its score and the filters it meets, in the given order."""
    band = F.when(score >= 0.8, "high similarity").when(score >= 0.6, "good similarity").when(score >= 0.4, "moderate similarity")
    return F.array_compact(F.array(band, *[F.when(c, F.lit(f"matches {k}")) for k, c in matched.items()]))


class Postings:
    """An inverted index of a collection's words in the shared folder: (bucket, term, doc_id, tf, len), partitioned by a
    hash of the term and sorted by term, and the collection's size and mean length. It is built once; a query reads only
    the buckets of its terms, and of these only row groups that can hold them."""

    BUCKETS = 64

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.spark, self.path = docs.sparkSession, scratch_path(docs.sparkSession, "postings")
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
        rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), words.alias("w"))
        # a document's terms are counted where it is read: sorted words fall into runs
        runs = rows.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"), F.max("len").alias("len"))
        self.schema = runs.withColumn("bucket", F.lit(0)).schema
        out = runs.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", F.col("bucket"))
        out.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self.path)
        stats = docs.where(F.col(doc_id).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.regexp_count(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"))).alias("mean")).first()
        self.n, self.mean = stats["n"], stats["mean"] or 1.0

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.BUCKETS)).cast("int")

    def lookup(self, terms: list[str]) -> DataFrame:
        """(doc_id, term, tf, len) of the given terms."""
        wanted = F.array(*[F.lit(t) for t in terms])
        buckets = self.spark.range(1).select(F.transform(wanted, self._bucket).alias("b")).first()["b"]
        found = self.spark.read.schema(self.schema).parquet(self.path)
        return found.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("term").isin(terms)).drop("bucket")

    def bm25(self, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc_id, score) of every document with a query term; idf is ln(1 + (N - df + 0.5) / (df + 0.5)), lengths and
        document frequencies are those of the whole collection."""
        terms = list(dict.fromkeys(t.lower() for t in query))
        if not terms or not all(re.fullmatch("[a-z0-9]+", t) for t in terms):
            raise ValueError("query terms are words of ASCII letters and digits")
        found = self.lookup(terms)
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        both = found.join(F.broadcast(df), "term")  # one row for each query term
        idf = F.log(1 + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(self.mean))))
        return both.groupBy("doc_id").agg(F.sum(part).alias("score"))


def bm25(docs: DataFrame, query: list[str], doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """:meth:`Postings.bm25` of a collection without an index."""
    return Postings(docs, doc_id, text).bm25(query, k1, b)


def fuse_by_words(hits: DataFrame, docs: DataFrame, query: list[str], weight: float = 0.7, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): semantic hits (id, score) reranked by the share of the query's words that their text has."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    own = docs.select(id_col, (F.size(F.array_intersect(words, F.array(*[F.lit(t.lower()) for t in query]))) / len(set(query))).alias("kw"))
    return hits.select(id_col, "score").join(own, id_col, "left").select(id_col, (F.col("score") * weight + F.coalesce("kw", F.lit(0.0)) * (1 - weight)).alias("score"))


def fuse_raw(semantic: DataFrame, keyword: DataFrame, weight: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """(id, score): the semantic hits with their unscaled keyword score added by weight."""
    return semantic.select(id_col, F.col("score").alias("sem")).join(keyword.select(id_col, F.col("score").alias("kw")), id_col, "left").select(id_col, (F.col("sem") * weight + F.coalesce("kw", F.lit(0.0)) * (1 - weight)).alias("score"))


def fuse_both(semantic: DataFrame, keyword: DataFrame, weight: float = 0.6, id_col: str = "doc_id") -> DataFrame:
    """(id, score): weighted where a row is in both lists, else the score of the one that has it."""
    both = semantic.select(id_col, F.col("score").alias("sem")).join(keyword.select(id_col, F.col("score").alias("kw")), id_col, "full_outer")
    return both.select(id_col, F.coalesce(F.col("sem") * weight + F.col("kw") * (1 - weight), "sem", "kw").alias("score"))


def scaled(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores brought to 0 .. 1 by the smallest and the greatest; 1 where all are equal. The two are joined as one row."""
    edges = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return df.join(F.broadcast(edges)).withColumn(score, F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)).drop("_lo", "_hi")


def popularity_boost(score: Column, trust: Column, age_days: Column, stars: Column) -> Column:
    """A score times one plus boosts for trust, youth and stars."""
    by = lambda c, *steps: F.coalesce(reduce(lambda a, s: a.when(s[0](c), s[1]), steps[1:], F.when(steps[0][0](c), steps[0][1])).otherwise(0.0), F.lit(0.0))
    quality = by(trust, (lambda c: c > 8, 0.2), (lambda c: c > 6, 0.1))
    recent = by(age_days, (lambda c: c < 30, 0.1), (lambda c: c < 180, 0.05))
    known = by(stars, (lambda c: c > 10_000, 0.15), (lambda c: c > 1_000, 0.1), (lambda c: c > 100, 0.05))
    return score * (1 + quality + recent + known)


def fuse_weighted(semantic: DataFrame, keyword: DataFrame, weight: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """(id, score): keyword scores divided by their maximum, both sides joined, a missing side counts 0."""
    top = keyword.agg(F.max("score").alias("top"))
    kw = keyword.join(F.broadcast(top)).select(id_col, F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("kw"))
    out = semantic.select(id_col, F.col("score").alias("sem")).join(kw, id_col, "full_outer")
    return out.select(id_col, (F.coalesce("sem", F.lit(0.0)) * weight + F.coalesce("kw", F.lit(0.0)) * (1 - weight)).alias("score"))


def fuse_ranks(lists: list[DataFrame], id_col: str = "doc_id", constant: int = 60) -> DataFrame:
    """(id, score): reciprocal rank fusion of ranked lists with columns (id, rank)."""
    every = lists[0].select(id_col, "rank")
    for x in lists[1:]:
        every = every.union(x.select(id_col, "rank"))
    return every.groupBy(id_col).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def facet_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) of each field's values, null as "(none)"; one pass with one row for each field and input row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("(none)")).alias("value")) for f in fields]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def retrieval_quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, ndcg, mrr) at ``k``; ``results`` has (query_id, match_id, rank), ``relevant`` has
    (query_id, match_id, gain). Queries without a relevant row are left out; those without a result score 0."""
    top = results.where(F.col("rank") <= k).select("query_id", "match_id", "rank").dropDuplicates(["query_id", "match_id"])
    rel = relevant.groupBy("query_id", "match_id").agg(F.max("gain").alias("gain"))
    ideal = rel.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "match_id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg"))
    hits = top.join(rel, ["query_id", "match_id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    out = ideal.join(hits, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "query_id",
        zero(F.col("hits") / F.col("n")).alias("recall"),
        zero(F.col("hits") / F.lit(k)).alias("precision"),
        F.when(F.col("idcg") > 0, zero(F.col("dcg") / F.col("idcg"))).otherwise(0.0).alias("ndcg"),
        zero(1 / F.col("first")).alias("mrr"),
    )


def suggestions(names: DataFrame, name: str, prefix: str, weight: str, k: int) -> DataFrame:
    """The ``k`` names that begin with a prefix, case ignored, by descending weight; null weights last, ties by name."""
    return names.where(F.lower(name).startswith(prefix.lower())).groupBy(name).agg(F.max(weight).alias(weight)).orderBy(F.desc_nulls_last(weight), name).limit(k)
