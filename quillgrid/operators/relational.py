"""Joins and set operations that Spark has no operator for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from quillgrid.operators.ordered import in_order, with_carry, within


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the right side's keys are dropped. Both sides may come from one table."""
    names = [f"_k{i}" for i in range(len(keys))]
    r = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    return left.join(r, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]), how).drop(*names)


def interval_join(points: DataFrame, ranges: DataFrame, on: list[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Rows of both where start <= at < end, for the same ``on`` values.

    Ranges are put into bins of ``width`` over the numeric axis, so both sides meet by an equality; the bins of a range
    are as many as it is long. Rows with a null bound or point meet nothing.
    """
    p = points.withColumn("_bin", F.floor(F.col(at) / width).cast("bigint"))
    full = ranges.where(F.col(start).isNotNull() & (F.col(end) > F.col(start)))
    r = full.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width).cast("bigint"), F.ceil(F.col(end) / width).cast("bigint") - 1)))
    return p.join(r, [*on, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the latest right row at or before its time, null without one.

    Both sides are put into one ordered stream for each key and the last right row is carried along, over the borders of
    ranges too: one shuffle and no pairs. Of right rows at one time the greatest values win.
    """
    side = lambda df, time, n, cols: df.select(*on, F.col(time).alias("_t"), F.lit(n).alias("_side"), *cols)
    packed = F.struct(*[F.col(v) for v in values])
    r = side(right.where(F.col(right_time).isNotNull()), right_time, 0, [packed.alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_l")])
    lf = side(left, left_time, 1, [F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l")])
    rows = in_order(r.unionByName(lf), on, ["_t", "_side", "_r"])
    carried = F.max(F.when(F.col("_side") == 0, F.struct("_t", "_r")))
    rows = with_carry(rows, on, {"_carried": carried}, F.max)
    last = F.last("_r", True).over(within(on, ["_t", "_side", "_r"]))
    out = rows.withColumn("_last", F.coalesce(last, F.col("_carried")["_r"])).where("_side = 1")
    return out.select("_l.*", *[F.col("_last")[v].alias(v if v not in left.columns else v + "_right") for v in values])


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """Inner join in which every key of the left side is spread over ``salts`` tasks; the right side is repeated."""
    one = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return one.join(many, [*on, "_salt"]).drop("_salt")


def gaps_and_islands(df: DataFrame, keys: list[str], at: str, gap_seconds: int) -> DataFrame:
    """(*keys, session, first, last, n): runs of rows no more than a gap apart."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = with_carry(in_order(df.where(F.col(at).isNotNull()), keys, [at]), keys, {"_before": F.max(at)}, F.max)
    previous = F.coalesce(F.lag(at).over(Window.partitionBy("_p", *keys).orderBy(at)), F.col("_before"))
    new = F.coalesce(micros(F.col(at)) - micros(previous) >= gap_seconds * 1_000_000, F.lit(True))
    rows = with_carry(rows.withColumn("_new", new.cast("int")).drop("_before"), keys, {"_begun": F.sum("_new")}, F.sum)
    rows = rows.withColumn("session", F.coalesce("_begun", F.lit(0)) + F.sum("_new").over(within(keys, [at])))
    return rows.groupBy(*keys, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
