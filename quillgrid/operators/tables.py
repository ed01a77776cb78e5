"""Keyed tables: upserts, versions, retention, expiry, eviction, cache lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.plans.materialize import materialize



def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest ``order`` for each key (null orders come first); keyed aggregates, no window."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in df.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after the changes: the last write of each key wins, table and changes alike."""
    return latest_by_key(table.unionByName(changes), keys, order)


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str], deleted: str) -> DataFrame:
    """:func:`upsert` with deletions: a key whose last change has ``deleted`` true is gone."""
    every = table.withColumn(deleted, F.lit(False)).unionByName(changes)
    return latest_by_key(every, keys, order).where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null keeps the row."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def keep_versions(df: DataFrame, key: str, version: str, n: int) -> DataFrame:
    """The newest ``n`` distinct versions of each key, all of their rows; versions are ranked on a table of (key, version)."""
    versions = df.select(key, version).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    kept = versions.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
    return df.join(kept, [key, version], "left_semi")


def version_rollup(df: DataFrame, key: str, version: str, size: Column) -> DataFrame:
    """(key, versions, rows, total, largest, newest) of each key and, with key null, of all."""
    each = df.groupBy(key, version).agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    return each.rollup(key).agg(F.countDistinct(version).alias("versions"), F.sum("n").alias("rows"), F.sum("s").alias("total"), F.max("s").alias("largest"), F.max(version).alias("newest"))


def unexpired(df: DataFrame, created: str, as_of: Column, seconds: int) -> DataFrame:
    """Rows younger than ``seconds`` at ``as_of``; rows without a time have expired."""
    return df.where(F.col(created) > as_of - F.make_interval(secs=F.lit(seconds)))


def evict_least_used(df: DataFrame, accessed: str, count: str, tie: str, most: int, keep_share: float = 0.8) -> DataFrame:
    """What stays of a cache that holds more than ``most`` rows: the ``keep_share * most`` most recently used ones.

    The border is found as the k-th greatest (accessed, count, tie), so only that many keys are sorted.
    """
    n = df.count()
    if n <= most:
        return df
    key = F.struct(F.col(accessed), F.col(count), F.col(tie))
    border = df.select(key.alias("k")).orderBy(F.desc("k")).limit(int(most * keep_share)).agg(F.min("k").alias("_border"))
    return df.join(F.broadcast(border)).where(key >= F.col("_border")).drop("_border")  # one row


def cache_probe(requests: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests by the cache's keys."""
    known = cache.select(*keys).distinct()
    return requests.join(known, keys, "left_semi"), requests.join(known, keys, "left_anti")


def combine_results(requests: DataFrame, cached: DataFrame, computed: DataFrame, key: str, value: str) -> DataFrame:
    """Requests with ``value`` and ``status``: cached before computed, failed where neither has it."""
    a = cached.groupBy(key).agg(F.first(value, True).alias("_a"))
    b = computed.groupBy(key).agg(F.first(value, True).alias("_b"))
    out = requests.join(a, key, "left").join(b, key, "left")
    status = F.when(F.col("_a").isNotNull(), "cached").when(F.col("_b").isNotNull(), "computed").otherwise("failed")
    return out.withColumns({value: F.coalesce("_a", "_b"), "status": status}).drop("_a", "_b")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Append ``batch_id``: consecutive runs of ``size`` rows by ``order``.

    Rows are range-partitioned; the numbers of rows in earlier partitions are added to positions inside each.
    """
    ordered = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "batches")
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row for each partition
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    out = ordered.withColumn("_i", place).join(F.broadcast(before), "_p")
    return out.withColumn("batch_id", F.floor((F.col("_base") + F.col("_i")) / size).cast("bigint")).drop("_p", "_i", "_base")
