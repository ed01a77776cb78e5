"""Writers: versioned stores, upserts into a folder, JSON with checksums, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillgrid.operators.tables import latest_by_key
from quillgrid.plans.materialize import child_names, delete_folder, finished_runs, materialize


def version_id(at: Column) -> Column:
    """v_<seconds>_<microseconds> of a time; sorts as time does."""
    micros = F.unix_micros(at)
    return F.format_string("v_%010d_%06d", F.floor(micros / 1_000_000).cast("bigint"), F.pmod(micros, F.lit(1_000_000)))


def version_time(version: Column) -> Column:
    """The time of a version id, null for other texts."""
    s, m = (F.regexp_extract(version, r"^v_(\d+)_(\d{6})$", i) for i in (1, 2))
    return F.when(s != "", F.timestamp_micros(s.cast("bigint") * 1_000_000 + m.cast("bigint")))


def write_version(df: DataFrame, path: str, at: Column) -> None:
    """Append rows as a new version of their libraries: partitions by library_id and version_id, gzip Parquet.

    Rows of one library are gathered before writing, and a large one is spread by AQE's rebalance.
    """
    out = df.withColumn("version_id", version_id(at)).hint("rebalance", "library_id")
    out.write.mode("append").partitionBy("library_id", "version_id").option("compression", "gzip").parquet(path)


#: Buckets of a keyed store, by a hash of the key.
BUCKETS = 16


def write_upsert(changes: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Merge changes into the keyed store at ``path``: last write of each key wins.

    A merge writes a new version of the buckets that the changes touch and leaves the others alone; readers take of each
    bucket the newest version that is finished, so a failed write changes nothing. Versions stay until :func:`vacuum`.
    """
    spark = changes.sparkSession
    bucketed = materialize(changes.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")), "changes")
    touched = sorted(r[0] for r in bucketed.select("_bucket").distinct().collect())  # at most BUCKETS numbers
    newest: dict[str, str] = {}
    runs = finished_runs(spark, path)
    for run in runs:
        newest |= {b: f"{run}/{b}" for b in child_names(spark, run)}
    old = [(b, newest[f"_bucket={b}"]) for b in touched if f"_bucket={b}" in newest]
    merged = bucketed
    for b, folder in old:
        merged = merged.unionByName(spark.read.schema(changes.schema).parquet(folder).withColumn("_bucket", F.lit(b)))
    last = int(runs[-1].rpartition("run-")[2]) if runs else -1
    latest_by_key(merged, keys, order).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/run-{last + 1:09d}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete versions of which no bucket is current any more; returns their number."""
    runs, held, gone = finished_runs(spark, path), set(), 0
    for run in reversed(runs):
        own = set(child_names(spark, run))
        if own <= held:
            delete_folder(spark, run)
            gone += 1
        held |= own
    return gone


def write_json_checked(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write rows as gzip JSON lines and return (key, bytes, sha256) of each row's JSON text."""
    text = F.to_json(F.struct(*sorted(df.columns)))
    df.write.mode("overwrite").option("compression", "gzip").json(path)
    return df.select(key, F.octet_length(text).alias("bytes"), F.sha2(text, 256).alias("sha256"))


def compact(path: str, out: str, df: DataFrame, target_files: int) -> None:
    """Rewrite a folder of many small files as ``target_files`` files elsewhere."""
    df.sparkSession.read.parquet(path).repartition(target_files).write.parquet(out)


def incremental_backup(df: DataFrame, changed: str, since: Column, path: str) -> int:
    """Write rows changed after ``since`` and a manifest (written_at, rows, first, last) beside them; returns their
    number. The manifest comes last, so a backup without one has failed."""
    spark = df.sparkSession
    name = f"run-{uuid.uuid4().hex}"
    df.where(F.col(changed) > since).write.parquet(f"{path}/data/{name}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/data/{name}")
    facts = rows.agg(F.count("*").alias("rows"), F.min(changed).alias("first"), F.max(changed).alias("last"))
    facts.select(F.lit(name).alias("name"), F.current_timestamp().alias("written_at"), "rows", "first", "last").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return read_manifest(spark, path).where(F.col("name") == name).first()["rows"]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, written_at, rows, first, last) of each backup under a path."""
    return spark.read.parquet(f"{path}/manifest")
