"""Readers: JSON and text documents, checked binaries, JSON lines, versioned stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgrid.operators.documents import document_shape, parsed
from quillgrid.plans.materialize import child_names, finished_runs


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, shape): one row for each file, plain or compressed by its suffix, text or JSON alike."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("shape", document_shape(F.col("text")))


def split_corrupt(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(good, corrupt): documents whose JSON parses, if need be after mending trailing commas, and all others."""
    good = parsed(F.col(text)).isNotNull()
    return docs.where(good), docs.where(~good | F.col(text).isNull())


def with_format(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``format`` (json or text) and ``content``: that of a JSON object under its name, else the whole text."""
    is_json = F.ltrim(text).startswith("{")
    content = F.when(is_json, F.try_variant_get(parsed(F.col(text)), "$.content", "string")).otherwise(F.col(text))
    return rows.select("*", F.when(is_json, "json").otherwise("text").alias("format"), content.alias("content"))


def read_quality_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, format, content): JSON objects keep their text, anything else is its own content."""
    return with_format(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


# Names under which a search response has its list, and a documentation response its text.
RESULT_NAMES = ("results", "libraries", "data", "items")
TEXT_NAMES = ("content", "documentation", "text", "body")


def search_rows(responses: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(*keep, library_id, name, description, trust_score, stars): the libraries of each response, which is a list, an
    object with a list under one of several names, or a single object. What has no library_id or id gives no row."""
    v = F.try_parse_json(F.col(text))
    kind = F.schema_of_variant(v)
    nested = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<variant>") for n in RESULT_NAMES])
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.coalesce(nested, F.array(v)))
    got = lambda path, kind: F.try_variant_get(F.col("_v"), path, kind)
    out = responses.select(*keep, F.explode(items).alias("_v")).select(
        *keep,
        F.coalesce(got("$.library_id", "string"), got("$.id", "string")).alias("library_id"),
        F.coalesce(got("$.name", "string"), got("$.title", "string")).alias("name"),
        got("$.description", "string").alias("description"),
        got("$.trust_score", "double").alias("trust_score"),
        got("$.stars", "bigint").alias("stars"),
    )
    return out.where("library_id is not null")


def response_text(response: Column) -> Column:
    """The text of a documentation response: a JSON string's own, an object's under one of several names, else the response
    as it is."""
    v = F.try_parse_json(response)
    named = [F.try_variant_get(v, f"$.{n}", "string") for n in TEXT_NAMES]
    own = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(*named, own, response)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store of :func:`quillgrid.sources.writers.write_upsert`: of each bucket the newest finished version."""
    newest: dict[str, str] = {}
    for run in finished_runs(spark, path):
        for bucket in child_names(spark, run):
            if bucket.startswith("_bucket="):
                newest[bucket] = f"{run}/{bucket}"
    return spark.read.parquet(*newest.values())


def read_checked(spark: SparkSession, path: str, checksums: DataFrame | None = None) -> DataFrame:
    """(path, length, sha256, is_gzip, intact): binary files, held against ``checksums`` (path, sha256) where given."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 2) == F.unhex(F.lit("1F8B"))).alias("is_gzip"))
    if checksums is None:
        return rows.withColumn("intact", F.lit(None).cast("boolean"))
    return rows.join(checksums.select("path", F.col("sha256").alias("_wanted")), "path", "left").withColumn("intact", F.col("sha256") == F.col("_wanted")).drop("_wanted")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; a row that doesn't parse has its text in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_version(spark: SparkSession, path: str, library_id: str, version: str = "latest") -> DataFrame:
    """Rows of one version of a library in a store of :func:`quillgrid.sources.writers.write_version`.

    Only the partitions of the library are read, and of these only the version asked for.
    """
    own = spark.read.parquet(path).where(F.col("library_id") == library_id)
    if version != "latest":
        return own.where(F.col("version_id") == version)
    newest = own.agg(F.max("version_id").alias("v")).first()["v"]
    return own.where(F.col("version_id") == F.lit(newest))


def list_versions(spark: SparkSession, path: str) -> DataFrame:
    """(library_id, version_id, rows)."""
    return spark.read.parquet(path).groupBy("library_id", "version_id").agg(F.count("*").alias("rows"))
