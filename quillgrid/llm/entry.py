"""The numbered problems' queries over the given tables, each over its whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.llm import batch_history, boilerplate, canonical, near_duplicates, packing, pair_sql, subjects, token_budget, tokenizer
from quillgrid.plans.materialize import materialize

CUTOFF = "2026-03-01 00:00:00"
#: p4_update: the corpus before the update ends here, the one after it begins there.
UPDATED, KEPT_FROM = "2026-03-01 00:00:00", "2026-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies_found(canonical.formatting_groups(table(spark, d, "documentation_entry")))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    groups = canonical.copy_counts(canonical.formatting_groups(table(spark, d, "documentation_entry")))
    return groups.select("first_id", "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "embedding_cache").select("cache_id", "job_id", "content")
    rows = batch_history.with_job_time(texts, table(spark, d, "ingestion_job"))
    return batch_history.found_pairs(batch_history.batch_duplicates(rows, CUTOFF, at="job_created_at"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """The forest's recall at each length of prefixes, whole keys first, over the alike pairs of the whole table."""
    return batch_history.recall_by_length(table(spark, d, "embedding_cache"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs = boilerplate.prepared_documents(table(spark, d, "document_embedding"))
    return boilerplate.block_occurrences(docs, boilerplate.library_blocks(docs)).select("id", "line_no")


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = boilerplate.library_blocks(boilerplate.prepared_documents(table(spark, d, "document_embedding")))
    return blocks.groupBy("library_id", "block").agg(F.count("*").alias("lines"), F.max("support").alias("support"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "document_embedding")
    blocks = boilerplate.library_blocks(boilerplate.prepared_documents(source))
    return boilerplate.remove_blocks(source.select("id", "library_id", "content"), blocks).select("id", "content", "lines_removed")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "document_embedding")
    counts = token_budget.CountTable(spark, tokenizer.Vocabulary(spark))
    counts.refresh(source, "content")
    rows = source.where(~canonical.is_blank(F.col("content"))).select("id", "indexed_at", "token_count", token_budget.text_key(F.col("content")).alias("text_key"))
    return token_budget.wrong_counts(counts.counts_of_keys(token_budget.latest_rows(rows)))


def _budget_state(spark: SparkSession, d: str, rows: DataFrame, counts: token_budget.CountTable) -> DataFrame:
    """One row for each id of ``rows`` with its slices and its number of tokens; the count table is refreshed first."""
    counts.refresh(rows, "content")
    keyed = rows.select("id", "indexed_at", "library_id", "programming_language", token_budget.text_key(F.col("content")).alias("text_key"))
    return token_budget.with_slices(counts.counts_of_keys(token_budget.latest_rows(keyed)), table(spark, d, "language_alias"), table(spark, d, "library_info"))


def p4_budget(spark: SparkSession, d: str) -> DataFrame:
    counts = token_budget.CountTable(spark, tokenizer.Vocabulary(spark))
    state = _budget_state(spark, d, table(spark, d, "document_embedding"), counts)
    return token_budget.budget_cube(token_budget.apply_deltas(None, token_budget.signed_deltas(None, state)))


def p4_update(spark: SparkSession, d: str) -> DataFrame:
    """The cube's cells after the corpus has moved on: it held the rows indexed before UPDATED and now holds those
    indexed from KEPT_FROM on, so documents come, change and go. ``token_drift`` is what the cells kept by deltas differ
    by from those counted afresh."""
    source = table(spark, d, "document_embedding")
    counts = token_budget.CountTable(spark, tokenizer.Vocabulary(spark))
    before = materialize(_budget_state(spark, d, source.where(F.col("indexed_at") < F.lit(UPDATED).cast("timestamp_ntz")), counts), "budget-before")
    cells = materialize(token_budget.apply_deltas(None, token_budget.signed_deltas(None, before)), "cells")
    after = materialize(_budget_state(spark, d, source.where(F.col("indexed_at") >= F.lit(KEPT_FROM).cast("timestamp_ntz")), counts), "budget-after")
    kept = token_budget.apply_deltas(cells, token_budget.signed_deltas(before, after))
    return token_budget.with_drift(kept, token_budget.apply_deltas(None, token_budget.signed_deltas(None, after)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups_found(near_duplicates.near_duplicate_groups(table(spark, d, "documentation_entry")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, d, "documents"), tokenizer.Vocabulary(spark))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = tokenizer.Vocabulary(spark)
    return tokenizer.decode_documents(tokenizer.encode_documents(table(spark, d, "documents"), vocabulary), vocabulary)


def p6_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.offset_documents(table(spark, d, "documents"), tokenizer.Vocabulary(spark))


def p6_covered(spark: SparkSession, d: str) -> DataFrame:
    """How many characters of each document its tokens touch by their offsets: all of them."""
    return tokenizer.covered_characters(p6_offsets(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokenizer.token_counts(table(spark, d, "documents"), tokenizer.Vocabulary(spark), "text", ("doc_id",)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(_packed(spark, d))


def p7_slots(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_area"), table(spark, d, "subject_label"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject_id").distinct()


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of each subject, subjects without any included."""
    totals = _subjects(spark, d).groupBy("subject_id").agg(F.countDistinct("doc_id").alias("documents"), F.sum("sentences").alias("sentences"))
    out = table(spark, d, "subject_area").select("subject_id", "subject").join(totals, "subject_id", "left")
    return out.select("subject_id", "subject", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("sentences", F.lit(0)).alias("sentences"))


def p8_topics(spark: SparkSession, d: str) -> DataFrame:
    """The top terms of every topic, and the subject that it is mapped to by them."""
    areas = table(spark, d, "subject_area")
    _, _, models, mapped, ids = subjects.mapped_topics(table(spark, d, "documents"), areas, table(spark, d, "subject_label"))
    return subjects.topic_terms(models, mapped, areas, ids)


def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    return subjects.held_out_agreement(table(spark, d, "documents"), table(spark, d, "subject_area"), table(spark, d, "subject_label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_copies, p2_found, p2_recall, p3_found, p3_blocks, p3_clean, p4_found, p4_budget, p4_update, p5_found, p6_ids, p6_offsets, p6_covered, p6_round_trip, p7_found, p7_slots, p8_found, p8_totals, p8_topics, p8_held_out)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """DuckDB's version of the queries that SQL can express."""
    latest = "d AS (SELECT DISTINCT ON (id) id, library_id, content FROM document_embedding WHERE id IS NOT NULL ORDER BY id, indexed_at DESC NULLS LAST)"
    lines = "l AS (SELECT id, library_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM d WHERE library_id IS NOT NULL)"
    keys = "k AS (SELECT id, library_id, line_no, regexp_replace(upper(line), '[^\\pL]+', '', 'g') AS key FROM l)"
    totals = "n AS (SELECT library_id, count(*) AS n FROM d GROUP BY 1)"
    repeated = "r AS (SELECT library_id, key FROM k JOIN n USING (library_id) WHERE length(key) >= 15 GROUP BY library_id, key, n HAVING count(DISTINCT id) >= 12 AND count(DISTINCT id) >= 0.1 * n)"
    found = f"WITH {latest}, {lines}, {keys}, {totals}, {repeated} SELECT id, line_no::int AS line_no FROM k JOIN r USING (library_id, key)"
    own_keys = "o AS (SELECT library_id, list(key) AS keys FROM r GROUP BY 1)"
    kept_lines = "list_filter(string_split(content, chr(10)), lambda x: NOT list_contains(keys, regexp_replace(upper(x), '[^\\pL]+', '', 'g')))"
    parts = f"s AS (SELECT id, content, string_split(content, chr(10)) AS every, CASE WHEN keys IS NULL THEN NULL ELSE {kept_lines} END AS kept FROM document_embedding LEFT JOIN o USING (library_id))"
    clean = f"WITH {latest}, {lines}, {keys}, {totals}, {repeated}, {own_keys}, {parts} SELECT id, CASE WHEN kept IS NULL OR len(kept) = len(every) THEN content ELSE array_to_string(kept, chr(10)) END AS content, coalesce(len(every) - len(kept), 0)::int AS lines_removed FROM s"
    rows = f"d AS (SELECT DISTINCT ON (id) id, library_id, programming_language FROM document_embedding WHERE id IS NOT NULL AND indexed_at >= TIMESTAMP '{KEPT_FROM}' ORDER BY id, indexed_at DESC)"
    alias = "a AS (SELECT lower(trim(alias)) AS alias, min(language) AS language FROM language_alias GROUP BY 1)"
    cell = "coalesce(d.library_id, '(unknown)') AS library_id, coalesce(a.language, '(unknown)') AS language, coalesce(i.category, '(unknown)') AS category"
    update = f"WITH {rows}, {alias} SELECT {cell}, count(*) AS documents, 0::bigint AS token_drift FROM d LEFT JOIN a ON lower(trim(d.programming_language)) = a.alias LEFT JOIN library_info i ON d.library_id = i.library_id GROUP BY 1, 2, 3"
    return {
        "p1_found": pair_sql.P1_FOUND,
        "p1_copies": pair_sql.P1_COPIES,
        "p2_found": pair_sql.p2_found(CUTOFF),
        "p5_found": pair_sql.P5_FOUND,
        "p3_clean": clean,
        "p4_update": update,
        "p6_covered": "SELECT doc_id, coalesce(n_chars, 0) AS n_chars FROM documents",
        "p3_found": found,
        "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
