"""Token budgets per source, language and domain (problem 4).

A count table holds (text_key, tokenizer, n_tokens): 128-bit hash of a text, name and hash of the tokenizer, tokens of
that text. Only texts whose key isn't in it are encoded. A cube of totals is kept up to date by signed deltas: what a
document counted for before is subtracted, what it counts for now is added, and a removed document is only subtracted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgrid.llm.tokenizer import Vocabulary, token_counts
from quillgrid.plans.materialize import finished_runs, materialize, scratch_path

COUNT_SCHEMA = "text_key string, tokenizer string, n_tokens bigint"
CUBE = ("library_id", "language", "category")
UNKNOWN = "(unknown)"


def latest_rows(df: DataFrame, doc_id: str = "id", version: str = "indexed_at") -> DataFrame:
    """One row for each distinct non-null id, the one of the latest ``version`` (null comes first); ties by content.

    A repeated id is combined before the shuffle; texts are moved once.
    """
    others = [c for c in df.columns if c != doc_id]
    best = df.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max_by(F.struct(*others), F.struct(version, F.xxhash64(*[c for c in others if not _is_map(df, c)]))).alias("r"))
    return best.select(doc_id, "r.*")


def _is_map(df: DataFrame, c: str) -> bool:
    return "map" in df.schema[c].dataType.simpleString()


def text_key(text: Column) -> Column:
    return F.md5(text)


class CountTable:
    """The count table as Parquet runs under ``path``; a run is added by each refresh."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary, path: str | None = None):
        self.spark, self.vocabulary, self.path = spark, vocabulary, path or scratch_path(spark, "token-counts")

    def _runs(self) -> list[str]:
        return finished_runs(self.spark, self.path)

    def read(self) -> DataFrame:
        """(text_key, n_tokens) under this table's tokenizer; empty where nothing has been counted yet.

        Runs are named one by one: Spark takes two reads of one folder for the same table, whatever came between.
        """
        runs = self._runs()
        table = self.spark.read.schema(COUNT_SCHEMA).parquet(*runs) if runs else self.spark.createDataFrame([], COUNT_SCHEMA)
        return table.where(F.col("tokenizer") == self.vocabulary.version).select("text_key", "n_tokens")

    def refresh(self, texts: DataFrame, text: str) -> None:
        """Encode the texts that the table doesn't have and append them as a run. Null texts are never stored.

        First the keys that are new are found, from keys alone; then texts with such a key are encoded where they are
        read. Only where there are too many new keys to broadcast are texts shuffled to meet them. A text that a third
        of all rows carry is encoded once by each task that reads it and counts once for each task in the shuffle.
        """
        rows = texts.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("text_key"), text)
        if self._runs():
            new_keys = materialize(rows.select("text_key").distinct().join(self.read(), "text_key", "left_anti"), "new-keys")
            rows = rows.join(new_keys, "text_key", "left_semi")
        new = token_counts(rows, self.vocabulary, text, ("text_key",)).groupBy("text_key").agg(F.max("n_tokens").alias("n_tokens"))
        new.select("text_key", F.lit(self.vocabulary.version).alias("tokenizer"), "n_tokens").write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")

    def counts_of_keys(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``n_tokens`` in place of their ``text_key`` and of a column of that name; a null key (a null
        text) has 0 tokens.

        Raises nothing for keys that the table doesn't have: their n_tokens is null until a refresh.
        """
        out = rows.drop("n_tokens").join(self.read().groupBy("text_key").agg(F.max("n_tokens").alias("n_tokens")), "text_key", "left")
        return out.withColumn("n_tokens", F.when(F.col("text_key").isNull(), F.lit(0)).otherwise(F.col("n_tokens")).cast("bigint")).drop("text_key")


def wrong_counts(counted: DataFrame, doc_id: str = "id", claimed: str = "token_count", over: float = 2.5, under: float = 0.4) -> DataFrame:
    """Ids whose claimed number of tokens is null, not positive, over ``over`` times or under ``under`` times the true one."""
    c, n = F.col(claimed), F.col("n_tokens")
    return counted.where(c.isNull() | (c <= 0) | (c > over * n) | (c < under * n)).select(F.col(doc_id).alias("id")).distinct()


def with_slices(rows: DataFrame, aliases: DataFrame, libraries: DataFrame) -> DataFrame:
    """Append ``language`` (by the alias table, case and margins ignored) and ``category`` of the library.

    What is null, empty or unknown there counts under "(unknown)". Both tables are joined without a hint: they are
    small, and Spark broadcasts them only while their measured size allows it.
    """
    alias = aliases.select(F.lower(F.trim("alias")).alias("_alias"), F.col("language").alias("_language")).where("_alias is not null").dropDuplicates(["_alias"])
    library = libraries.select(F.col("library_id").alias("_library"), F.col("category").alias("_category")).where("_library is not null").dropDuplicates(["_library"])
    out = rows.join(alias, F.lower(F.trim(rows["programming_language"])) == alias["_alias"], "left").join(library, rows["library_id"] == library["_library"], "left")
    return out.withColumns(
        {"language": F.coalesce("_language", F.lit(UNKNOWN)), "category": F.coalesce("_category", F.lit(UNKNOWN)), "library_id": F.coalesce("library_id", F.lit(UNKNOWN))}
    ).drop("_alias", "_language", "_library", "_category")


def signed_deltas(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """(library_id, language, category, documents, tokens): what each cell of the cube gains from one state to the next.

    States have one row for each id with its slices and n_tokens. Equal rows cancel out, an id that is only in
    ``before`` has been removed, and cells without a change don't appear.
    """
    signed = after.select(*CUBE, F.lit(1).alias("sign"), "n_tokens")
    if before is not None:
        signed = signed.union(before.select(*CUBE, F.lit(-1), "n_tokens"))
    out = signed.groupBy(*CUBE).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
    return out.where("documents <> 0 or tokens <> 0")


def apply_deltas(cells: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The finest cells of the cube after the deltas; cells that have become empty disappear."""
    every = deltas if cells is None else cells.select(*CUBE, "documents", "tokens").union(deltas.select(*CUBE, "documents", "tokens"))
    return every.groupBy(*CUBE).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")


def with_drift(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """(library_id, language, category, documents, token_drift) of the kept cells and of those that only a fresh count
    has: documents as kept, and by how many tokens kept and fresh counts differ."""
    k = kept.select(*CUBE, "documents", F.col("tokens").alias("kept"))
    both = k.join(fresh.select(*CUBE, F.col("tokens").alias("fresh")), list(CUBE), "full")
    return both.select(*CUBE, F.coalesce("documents", F.lit(0)).alias("documents"), (F.coalesce("kept", F.lit(0)) - F.coalesce("fresh", F.lit(0))).alias("token_drift"))


def budget_cube(cells: DataFrame) -> DataFrame:
    """Totals over every combination of library, language and category; null stands for all of a dimension."""
    return cells.cube(*CUBE).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
