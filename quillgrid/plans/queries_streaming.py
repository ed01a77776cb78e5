"""Streaming queries: each reads the events as a stream, runs over all of it and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.plans.materialize import scratch_path
from quillgrid.plans.registry import query, table
from quillgrid.sources.readers import read_current
from quillgrid.streaming import jobs as J


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return J.event_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)


def _last_batch(df: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in df.columns if c not in (*keys, "_batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("r")).select(*keys, "r.*")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = J.run_to_table(J.windowed(_stream(spark, d), ["event_type"], "ts", "1 hour", None, "1 hour", {"n": F.count("*"), "total": F.sum("value")}), "tumbling", "update")
    got = _last_batch(out, ["window_start", "event_type"])
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 30 MINUTE) + INTERVAL 30 MINUTE]) AS window_start, user_id FROM events) SELECT window_start, user_id, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = J.run_to_table(J.windowed(_stream(spark, d), ["user_id"], "ts", "1 hour", "30 minutes", "1 hour", {"n": F.count("*")}), "sliding", "update")
    return _last_batch(out, ["window_start", "user_id"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


_SESSIONS = """WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true)::int AS new FROM {rows}),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS window_start, count(*) AS n, max(value) AS most FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {rows})"""


def _sessions(stream: DataFrame, name: str) -> DataFrame:
    """Sessions that the watermark has closed; state holds the open ones only."""
    out = J.run_to_table(J.sessions(stream, ["user_id"], "ts", "30 minutes", "1 hour", {"n": F.count("*"), "most": F.max("value")}), name)
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "most")


@query(_SESSIONS.format(rows="events"))
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(_stream(spark, d), "session")


@query(_SESSIONS.format(rows="(FROM events WHERE value >= 60)"))
def stream_alert_runs(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of one user that follow each other within half an hour are one alert with its count and worst value."""
    return _sessions(_stream(spark, d).where("value >= 60"), "alert-runs")


#: Days of events that arrive together in stream_late.
_PART = 5


@query(f"""WITH e AS (SELECT *, (date_diff('day', (SELECT min(ts) FROM events)::date, ts::date) // {_PART}) + (event_type = 'error' AND value < 20)::int AS batch FROM events), m AS (SELECT batch, max(ts) AS top FROM e GROUP BY 1),
    w AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 HOUR AS mark FROM m), k AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, value FROM e JOIN w USING (batch) WHERE mark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > mark)
    SELECT window_start, count(*) AS n, round(sum(value), 6) AS total FROM k GROUP BY 1""")
def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive some days at a time, small errors a part too late: what is behind the watermark of the batch before
    is dropped, so rows late by one part still count while their window is open."""
    rows = table(spark, d, "events")
    first = rows.agg(F.min("ts").alias("t")).first()["t"]
    part = F.floor(F.datediff(F.col("ts").cast("date"), F.lit(first).cast("date")) / _PART) + F.coalesce((F.col("event_type") == "error") & (F.col("value") < 20), F.lit(False)).cast("int")
    path = scratch_path(spark, "arriving")
    parts = sorted(r[0] for r in rows.select(part.alias("p")).distinct().collect())  # one number for each part of the time
    for p in parts:
        rows.where(part == p).coalesce(1).write.mode("append").parquet(path)  # one file each, in order of their times
    stream = J.event_stream(spark, path, rows.schema, files_per_trigger=1)
    out = J.run_to_table(J.windowed(stream, [], "ts", "1 hour", None, "1 hour", {"n": F.count("*"), "total": F.sum("value")}), "late", "update")
    return _last_batch(out, ["window_start"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 6).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = J.without_repeats(_stream(spark, d), ["user_id", "event_type"], "ts", "400 days")
    return J.run_to_table(out, "dedup").select("user_id", "event_type")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "stream-upsert")
    J.upsert_each_batch(_stream(spark, d).select("user_id", "event_id", "ts", "value"), path, ["user_id"], ["ts", "event_id"])
    return read_current(spark, path).select("user_id", "event_id", "value")


@query("SELECT event_id, event_type, CASE WHEN value >= CASE event_type WHEN 'error' THEN 50 ELSE 90 END THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE (event_type = 'error' AND value >= 20) OR (event_type = 'purchase' AND value >= 60)")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    out = J.threshold_alerts(_stream(spark, d), "event_type", "value", {"error": (20, 50), "purchase": (60, 90)})
    return J.run_to_table(out, "alerts").select("event_id", "event_type", "severity")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) - 1 AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
    SELECT user_id, max(n) AS n, round(sum(pow(0.8, b) * CASE WHEN b = n - 1 THEN 1.0::double ELSE 0.2::double END * value), 6) AS ema FROM r GROUP BY user_id""")
def stream_moving_average(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = J.run_to_table(J.moving_averages(_stream(spark, d), "user_id", "ts", "value"), "ema", "update")
    return _last_batch(out, ["key"]).select(F.col("key").cast("bigint").alias("user_id"), "n", F.round("ema", 6).alias("ema"))


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, CASE WHEN value IS NULL THEN 1 WHEN value >= 90 THEN 3 WHEN value >= 60 THEN 2 ELSE 0 END AS s FROM events),
    w AS (SELECT window_start, event_type, count(*) AS checks, sum((s = 2)::int)::bigint AS warnings, sum((s = 3)::int)::bigint AS failed, ['healthy', 'unknown', 'warning', 'critical'][max(s) + 1] AS worst FROM e GROUP BY 1, 2)
    SELECT * FROM w WHERE window_start > (SELECT max(window_start) FROM w) - INTERVAL 24 HOUR""")
def stream_health(spark: SparkSession, d: str) -> DataFrame:
    """The worst state of each hour, of the last day that the stream has told; older history is let go."""
    v = F.col("value")
    state = F.when(v.isNull(), "unknown").when(v >= 90, "critical").when(v >= 60, "warning").otherwise("healthy")
    out = J.run_to_table(J.health_windows(_stream(spark, d), ["event_type"], "ts", state, "1 hour", "1 hour"), "health", "update")
    told = _last_batch(out, ["window_start", "event_type"])
    newest = told.agg(F.max("window_start").alias("_newest"))
    recent = told.join(F.broadcast(newest)).where(F.col("window_start") > F.col("_newest") - F.expr("interval 24 hours"))  # one row
    return recent.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "checks", "warnings", "failed", "worst")
