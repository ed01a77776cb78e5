"""Queries that write tables with the library's sinks and read them back with its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.operators import documents as DOC, tables as TB
from quillgrid.plans.materialize import scratch_path
from quillgrid.plans.registry import query, table
from quillgrid.sources import readers as R, writers as W

BACKUP_SINCE = "2026-06-01 00:00:00"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documentation_entry")


def _text_files(df: DataFrame, text: str, codec: str | None = None) -> str:
    """Write one text file for each row, named by Spark; returns the folder."""
    path = scratch_path(df.sparkSession, "texts")
    out = df.select(F.col(text).alias("value")).write.option("lineSep", "\n")
    (out.option("compression", codec) if codec else out).text(path)
    return path


@query("""SELECT library_id, version_id, count(*) AS rows FROM (SELECT library_id, 'v_' || lpad((epoch_us(min(fetched_at) OVER (PARTITION BY library_id, version)) // 1000000)::varchar, 10, '0') || '_' || lpad((epoch_us(min(fetched_at) OVER (PARTITION BY library_id, version)) % 1000000)::varchar, 6, '0') AS version_id
    FROM documents WHERE library_id IS NOT NULL AND version IS NOT NULL AND fetched_at IS NOT NULL) GROUP BY 1, 2""")
def stored_versions(spark: SparkSession, d: str) -> DataFrame:
    return R.list_versions(spark, _versioned(spark, d))


def _versioned(spark: SparkSession, d: str) -> str:
    """The documents as a versioned store: a version of a library is named by the time of its first document."""
    rows = table(spark, d, "documents").where("library_id is not null and version is not null and fetched_at is not null").select("doc_id", "library_id", "version", "text", "fetched_at")
    first = rows.groupBy("library_id", "version").agg(F.min("fetched_at").alias("at"))
    path = scratch_path(spark, "versions")
    W.write_version(rows.join(first, ["library_id", "version"]).drop("fetched_at"), path, F.col("at").cast("timestamp"))
    return path


@query("""WITH v AS (SELECT *, min(fetched_at) OVER (PARTITION BY library_id, version) AS first_at FROM documents WHERE library_id IS NOT NULL AND version IS NOT NULL AND fetched_at IS NOT NULL),
    l AS (SELECT library_id FROM v GROUP BY 1 ORDER BY count(*) DESC, library_id LIMIT 1) SELECT doc_id, version, sha256(text) AS sha FROM v WHERE library_id IN (FROM l) AND first_at = (SELECT max(first_at) FROM v WHERE library_id IN (FROM l))""")
def stored_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of the library of most documents, read from the store's partitions of that library."""
    own = table(spark, d, "documents").where("library_id is not null and version is not null and fetched_at is not null")
    top = own.groupBy("library_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "library_id").first()["library_id"]
    return R.read_version(spark, _versioned(spark, d), top).select("doc_id", "version", F.sha2("text", 256).alias("sha"))


@query("SELECT true AS whole, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)")
def gzip_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as gzip and read back: the codec is told by the files' suffix."""
    path = _text_files(table(spark, d, "documents").where("text is not null"), "text", "gzip")
    checked = R.read_checked(spark, path + "/*.gz").agg(F.min("is_gzip").alias("whole"))
    # texts hold line ends, so a file's lines are those of its texts
    return spark.read.option("lineSep", "\n").text(path).agg(F.count("*").alias("lines")).join(checked).select("whole", "lines")


@query("SELECT true AS intact, false AS changed, true AS plain")
def checked_files(spark: SparkSession, d: str) -> DataFrame:
    """Files held against their checksums: all are intact, none is after another checksum has been given, none is gzip."""
    path = _text_files(table(spark, d, "region"), "r_name")
    sums = R.read_checked(spark, path + "/part-*").select("path", "sha256")
    wrong = sums.select("path", F.sha2("sha256", 256).alias("sha256"))
    good = R.read_checked(spark, path + "/part-*", sums).agg(F.min("intact").alias("intact"), (~F.max("is_gzip")).alias("plain"))
    return good.join(R.read_checked(spark, path + "/part-*", wrong).agg(F.max("intact").alias("changed"))).select("intact", "changed", "plain")


@query("SELECT entry_id, title, try_cast(len(tags) AS int) AS tags FROM documentation_entry WHERE entry_id IS NOT NULL")
def json_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "json-lines")
    W.write_json_checked(_entries(spark, d).where("entry_id is not null").select("entry_id", "title", "tags"), path, "entry_id")
    back = R.read_json_lines(spark, path, "entry_id string, title string, tags array<string>")
    return back.where("_corrupt_record is null").select("entry_id", "title", F.size("tags").alias("tags"))


@query("SELECT n_nationkey, octet_length(encode('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}')) AS bytes, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS sha256 FROM nation")
def json_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Checksums are those of the JSON text with sorted keys."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    return W.write_json_checked(rows, scratch_path(spark, "json"), "n_nationkey")


@query("SELECT count(*) FILTER (WHERE json_valid(content) AND ltrim(content) LIKE '{%') AS objects, count(*) FILTER (WHERE NOT (json_valid(content) AND ltrim(content) LIKE '{%')) AS others FROM documentation_entry WHERE content IS NOT NULL")
def corrupt_split(spark: SparkSession, d: str) -> DataFrame:
    """Contents that are JSON objects, and all others."""
    rows = _entries(spark, d).where("content is not null").select(F.when(F.ltrim("content").startswith("{"), F.col("content")).alias("text"))
    good, bad = R.split_corrupt(rows)
    return good.agg(F.count("*").alias("objects")).join(bad.agg(F.count("*").alias("others")))


@query("SELECT job_id, json_extract_string(metadata, '$.category') AS category FROM (SELECT DISTINCT job_id, metadata FROM ingestion_job WHERE metadata IS NOT NULL)")
def mended_json(spark: SparkSession, d: str) -> DataFrame:
    """Job metadata broken by trailing commas and stray quotes, mended and read."""
    rows = table(spark, d, "ingestion_job").where("metadata is not null").select("job_id", "metadata").distinct()
    broken = rows.withColumn("metadata", F.regexp_replace("metadata", r"\}\s*$", ', "note": "it says "so" twice",}'))
    return broken.select("job_id", F.try_variant_get(DOC.parsed(F.col("metadata")), "$.category", "string").alias("category"))


@query("SELECT CASE WHEN ltrim(content) LIKE '{%' THEN 'json' ELSE 'text' END AS format, count(*) AS n, sum(length(content))::bigint AS characters FROM (SELECT replace(replace(content, chr(10), ' '), chr(13), ' ') AS content FROM documentation_entry WHERE content IS NOT NULL AND trim(content) <> '') GROUP BY 1")
def quality_documents(spark: SparkSession, d: str) -> DataFrame:
    """Contents as they come to the quality loader, JSON objects and plain text told apart."""
    flat = F.translate("content", "\n\r", "  ")
    rows = _entries(spark, d).where("content is not null and trim(content) <> ''").select(flat.alias("text"))
    return R.with_format(rows).groupBy("format").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


_SEARCH = "SELECT library_id, name, description, trust_score, stars FROM library_info"


@query(f"SELECT shape, library_id, name, round(trust_score, 6) AS trust_score, stars FROM ({_SEARCH}), (VALUES ('list'), ('results'), ('single')) s(shape)")
def search_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses that are a list, an object with a list under one of several names, or a single object."""
    info = table(spark, d, "library_info").select("library_id", "name", "description", "trust_score", "stars")
    one = F.to_json(F.struct("*"))
    lists = info.select("library_id", one.alias("j")).groupBy(F.substring("library_id", 1, 3).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("j"))  # a fixed table
    shapes = [lists.select(F.lit("list").alias("shape"), "j"), lists.select(F.lit("results"), F.concat(F.lit('{"results":'), "j", F.lit("}"))), info.select(F.lit("single"), one), lists.limit(1).select(F.lit("none"), F.lit('{"unexpected": 1}'))]
    every = shapes[0].union(shapes[1]).union(shapes[2]).union(shapes[3])
    return R.search_rows(every, "j", ["shape"]).select("shape", "library_id", "name", F.round("trust_score", 6).alias("trust_score"), "stars")


@query("SELECT entry_id, content FROM documentation_entry, (SELECT 1) WHERE content IS NOT NULL AND NOT (ltrim(content) LIKE '{%') AND trim(content) <> ''")
def documentation_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses that are plain text, a JSON string, or an object with the text under one of several names."""
    rows = _entries(spark, d).where("content is not null and not ltrim(content) like '{%' and trim(content) <> ''").select("entry_id", "content", F.pmod(F.xxhash64("entry_id"), F.lit(4)).alias("k"))
    as_string = F.expr("""substring(to_json(struct(content as x)), 6, length(to_json(struct(content as x))) - 6)""")
    names = F.element_at(F.array(F.lit("content"), F.lit("documentation"), F.lit("body")), F.greatest(F.col("k"), F.lit(1)).cast("int"))
    sent = rows.select("entry_id", F.when(F.col("k") == 0, as_string).otherwise(F.concat(F.lit('{"'), names, F.lit('":'), as_string, F.lit("}"))).alias("response"))
    return sent.select("entry_id", R.response_text(F.col("response")).alias("content"))


@query(f"SELECT count(*) AS rows, min(parsed_at) AS first, max(parsed_at) AS last FROM documentation_entry WHERE parsed_at > TIMESTAMP '{BACKUP_SINCE}'")
def incremental_backup(spark: SparkSession, d: str) -> DataFrame:
    """A backup of what has changed since a time, told by the manifest that it writes."""
    path = scratch_path(spark, "backup")
    W.incremental_backup(_entries(spark, d).drop("metadata"), "parsed_at", F.lit(BACKUP_SINCE).cast("timestamp_ntz"), path)
    return W.read_manifest(spark, path).select("rows", "first", "last")


@query("SELECT user_id, count(*) AS n, max(event_id) AS newest FROM events GROUP BY user_id")
def compacted_events(spark: SparkSession, d: str) -> DataFrame:
    """Many small files rewritten as a few."""
    rows = table(spark, d, "events").select("event_id", "user_id")
    small, large = scratch_path(spark, "small"), scratch_path(spark, "large")
    rows.repartition(40).write.parquet(small)
    W.compact(small, large, rows, 2)
    return spark.read.parquet(large).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT (event_type = 'error' AND value < 20) OR value IS NULL GROUP BY 1")
def purged_events(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a kind and value are deleted; a null value keeps its row."""
    kept = TB.delete_where(table(spark, d, "events"), (F.col("event_type") == "error") & (F.col("value") < 20))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upserted_store(spark: SparkSession, d: str) -> DataFrame:
    """A keyed store after three merges, of which each rewrites only the buckets that it touches."""
    rows, path = table(spark, d, "events").select("user_id", "event_id", "ts", "value"), scratch_path(spark, "store")
    for k in range(3):
        W.write_upsert(rows.where(F.pmod("event_id", F.lit(3)) == k), path, ["user_id"], ["ts", "event_id"])
    return R.read_current(spark, path).select("event_id", "user_id", "value")


@query("SELECT library_id, string_agg(version, ',' ORDER BY version DESC) AS versions FROM (SELECT DISTINCT library_id, version FROM documents WHERE library_id IS NOT NULL AND version IS NOT NULL) GROUP BY 1")
def versions_newest_first(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").where("library_id is not null and version is not null").select("library_id", "version").distinct()
    return pairs.groupBy("library_id").agg(F.array_join(F.sort_array(F.collect_set("version"), asc=False), ",").alias("versions"))  # versions of one library


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, line AS entry FROM l WHERE length(trim(line)) >= 20 QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id) = 1")
def first_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each line of 20 characters or more."""
    from quillgrid.operators.dedup import first_occurrence

    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("entry")).where(F.length(F.trim("entry")) >= 20)
    return first_occurrence(lines, ["entry"], ["doc_id"])
