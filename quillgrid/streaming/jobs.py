"""Structured Streaming: windows with watermarks, deduplication, upserts, alerts, keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillgrid.operators.tables import latest_by_key
from quillgrid.plans.materialize import scratch_path
from quillgrid.sources.writers import write_upsert


def event_stream(spark: SparkSession, path: str, schema: Any, ts: str = "ts", files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder (or a single file's folder by glob), ``ts`` as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there (availableNow) into a table of the shared folder and return that table.

    Append mode writes Parquet; update and complete modes keep, by batch, what each batch said (column ``_batch``).
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, name + "-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        schema = stream.schema
    else:
        query = writer.foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n).cast("bigint")).write.mode("overwrite").parquet(f"{out}/_b={n}")).start()
        schema = stream.withColumn("_batch", F.lit(0).cast("bigint")).schema
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
    reader = spark.read.schema(schema)
    return reader.parquet(out) if mode == "append" else reader.option("recursiveFileLookup", "true").parquet(out)


def windowed(stream: DataFrame, keys: list[str], ts: str, size: str, slide: str | None, late: str, aggregates: dict[str, Column]) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) windows; rows later than the watermark are dropped by Spark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _aggregated(stream.withWatermark(ts, late), w, keys, aggregates)


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str, aggregates: dict[str, Column]) -> DataFrame:
    """Windows that end when a key has been silent for ``gap``."""
    return _aggregated(stream.withWatermark(ts, late), F.session_window(ts, gap), keys, aggregates)


def _aggregated(stream: DataFrame, w: Column, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    out = stream.groupBy(w.alias("w"), *keys).agg(*[a.alias(name) for name, a in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def without_repeats(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark; state of older keys is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def upsert_each_batch(stream: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Keep a Parquet table of the last row of each key; every micro-batch is reduced before it is merged."""
    def merge(df: DataFrame, _: int) -> None:
        write_upsert(latest_by_key(df, keys, order), path, keys, order)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", scratch_path(stream.sparkSession, "upsert-state")).trigger(availableNow=True).start().awaitTermination()


def threshold_alerts(stream: DataFrame, metric: str, value: str, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows over a metric's (warning, critical) bounds with their ``severity``."""
    bounds = F.create_map(*[x for k, (w, c) in rules.items() for x in (F.lit(k), F.struct(F.lit(float(w)).alias("w"), F.lit(float(c)).alias("c")))])
    b = bounds[F.col(metric)]
    severity = F.when(F.col(value) >= b["c"], "critical").when(F.col(value) >= b["w"], "warning")
    return stream.withColumn("severity", severity).where(F.col("severity").isNotNull())


#: States of a check, from the best to the worst.
STATES = ("healthy", "unknown", "warning", "critical")


def health_windows(stream: DataFrame, keys: list[str], ts: str, severity: Column, size: str, late: str) -> DataFrame:
    """(window_start, window_end, *keys, checks, warnings, failed, worst) of each window; ``severity`` is one of STATES and
    the worst of a window's states is its own. State is kept until the watermark has passed a window."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), severity)
    count = lambda s: F.sum(F.when(severity == s, 1).otherwise(0))
    out = windowed(stream, keys, ts, size, None, late, {"checks": F.count("*"), "warnings": count("warning"), "failed": count("critical"), "_worst": F.max(rank)})
    return out.withColumn("worst", F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("_worst").cast("int"))).drop("_worst")


class MovingAverage(StatefulProcessor):
    """Exponential average of a key's values in the order of their times within each batch, kept between batches."""

    def __init__(self, keep: float = 0.8):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "ema double, n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ema, n = self.state.get() if self.state.exists() else (None, 0)
        for _, value in sorted((t, v) for pdf in rows for t, v in zip(pdf["ts"], pdf["value"]) if v == v and v is not None):
            ema, n = (value if ema is None else self.keep * ema + (1 - self.keep) * value), n + 1
        if ema is not None:
            self.state.update((float(ema), int(n)))
            yield pd.DataFrame({"key": [str(key[0])], "n": [int(n)], "ema": [float(ema)]})

    def close(self) -> None:
        pass


def moving_averages(stream: DataFrame, key: str, ts: str, value: str, keep: float = 0.8) -> DataFrame:
    """(key, n, ema) after each batch, in update mode; needs the RocksDB state store."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own Python worker gets no files
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(MovingAverage(keep), "key string, n bigint, ema double", "Update", "None")
