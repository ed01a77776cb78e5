"""Entities, tags, term weights and checks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.functions import patterns as P, text as X

# Shapes of the entities looked for, and words that are no configuration keys.
ENDPOINT = r"(?:GET|POST|PUT|DELETE|PATCH)\s+(/[^\s`]*)"
FENCED_CODE = r"(?s)```(?:\w+)?\n(.*?)\n```"
INLINE_CODE = r"`([^`\n]{6,200})`"
SETTING = r"([A-Z_][A-Z0-9_]{2,})\s*="
FLAG = r"--([a-zA-Z][a-zA-Z-]{2,})"
NO_KEYS = ("true", "false", "null", "undefined", "string", "number")


def _every(text: Column, pattern: str) -> Column:
    """Distinct matches of a pattern's group, sorted; empty for null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))))


def _found(text: Column, pattern: str, most: int) -> Column:
    return F.slice(_every(text, pattern), 1, most)


def endpoints(text: Column) -> Column:
    return _found(text, ENDPOINT, 10)


def code_snippets(text: Column) -> Column:
    """Fenced blocks first, then inline code, trimmed, distinct and under 500 characters; at most five of them."""
    both = F.array_union(F.transform(_every(text, FENCED_CODE), lambda x: F.btrim(x, F.lit(" \t\r\n"))), _every(text, INLINE_CODE))
    return F.slice(F.filter(both, lambda x: (x != "") & (F.length(x) < 500)), 1, 5)


def setting_keys(text: Column) -> Column:
    """Upper-cased keys before an equals sign and long flags, together at most 20."""
    every = F.array_union(_every(text, SETTING), _every(text, FLAG))
    return F.slice(F.array_sort(F.filter(every, lambda k: ~F.lower(k).isin(*NO_KEYS))), 1, 20)


def tags(text: Column) -> Column:
    """Up to 15 distinct tags in order: language, content type, features, technologies."""
    flags = [F.when(X.feature(text, k), F.lit(k.removeprefix("has_").replace("_", "-"))) for k in ("has_code_examples", "has_api_references", "has_installation_instructions", "has_configuration_details")]
    return F.slice(F.array_distinct(F.concat(F.array_compact(F.array(X.code_language(text), X.content_type(text), *flags)), X.technologies(text))), 1, 15)


def term_weights(docs: DataFrame, doc_id: str, text: str, most: int, least_documents: int = 2) -> DataFrame:
    """(doc_id, term, weight): the ``most`` terms of greatest tf-idf of each document, ties by term.

    idf is ln((N + 1) / (df + 1)) + 1 and weights are divided by the document's length in that space. Terms of fewer
    than ``least_documents`` documents are left out. Counts are keyed by (document, term), so a frequent term meets its
    df by a join that AQE may split, never in one group.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(*P.STOP_WORDS))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), words.alias("w"))
    tf = rows.select("doc_id", F.explode("w").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    n = docs.where(F.col(doc_id).isNotNull()).agg(F.countDistinct(doc_id).alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_documents)
    both = tf.join(df, "term").join(F.broadcast(n))  # one row
    raw = both.select("doc_id", "term", (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
    weighed = raw.select("doc_id", "term", F.round(F.col("x") / size, 6).alias("weight"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return weighed.withColumn("_p", place).where(F.col("_p") <= most).drop("_p")


def issues(df: DataFrame, row_id: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(row_id, rule, severity): one row for each rule whose condition holds; null conditions don't."""
    every = F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, (severity, cond) in rules.items()])
    return df.select(row_id, F.explode(F.array_compact(every)).alias("i")).select(row_id, "i.rule", "i.severity")


def recency(at: Column, as_of: Column, days: int = 365, most: float = 0.1) -> Column:
    """Falls from ``most`` to 0 within ``days`` before ``as_of``; 0 without a time, ``most`` at best."""
    age = F.greatest(F.lit(0), F.datediff(as_of, at))
    return F.coalesce(F.greatest(F.lit(0.0), (days - age) / days) * most, F.lit(0.0))


def boosted(score: Column, trust: Column, kind: Column, section: Column, wanted_kind: str, wanted_section: str) -> Column:
    """A score times factors for trust (1.3 from 9, 1.15 from 7, 1.05 from 5), document type (1.2) and section (1.1)."""
    by_trust = F.when(trust >= 9, 1.3).when(trust >= 7, 1.15).when(trust >= 5, 1.05).otherwise(1.0)
    return score * by_trust * F.when(kind == wanted_kind, 1.2).otherwise(1.0) * F.when(F.lower(section).contains(wanted_section), 1.1).otherwise(1.0)


def query_intent(query: Column) -> Column:
    """What a query asks for, by the first rule that fits: howto, troubleshooting, reference, example, else lookup."""
    low = F.lower(query)
    rule = lambda p: low.rlike(p)
    return F.when(rule(r"^(how|why)[^a-z]|how to"), "howto").when(rule(r"error|fail|fix|problem|issue"), "troubleshooting").when(rule(r"api|reference|parameter|notes on"), "reference").when(rule(r"example|sample|demo"), "example").otherwise("lookup")


def clamp(n: int, least: int = 1, most: int = 50) -> int:
    """A wished number of results within its bounds."""
    return max(least, min(most, n))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in a total order."""
    if number < 1 or size < 1:
        raise ValueError("pages and their size begin at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
