"""Running values within keys of any size.

Rows are put in ranges of key and order, so a key of a third of all rows spreads over many tasks. What a key brings from
the ranges before comes from one row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.plans.materialize import materialize


def in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in ranges of keys and order, written once, with the number ``_p`` of their range."""
    return materialize(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ordered")


def within(keys: list[str], order: list[str]) -> Window:
    """The rows of a range that have the same keys, up to the present one."""
    return Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def _last_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_p, _hi): the last key of each range."""
    return rows.groupBy("_p").agg(F.max(_key(keys)).alias("_hi"))


def with_carry(rows: DataFrame, keys: list[str], aggregates: dict[str, Column], fold: Callable[[Column], Column]) -> DataFrame:
    """Rows of :func:`in_order` with the aggregates over all rows of their key in the ranges before, null where it has
    none there. ``fold`` combines the aggregates of several ranges. Null keys are equal."""
    own = rows.join(F.broadcast(_last_keys(rows, keys)), "_p").where(_key(keys).eqNullSafe(F.col("_hi")))
    tails = own.groupBy("_p", "_hi").agg(*[a.alias(n) for n, a in aggregates.items()])
    upto = Window.partitionBy("_hi").orderBy("_p")
    summed = tails.select("_p", "_hi", *[fold(F.col(n)).over(upto).alias(n) for n in aggregates])
    before = F.lag(F.struct("_hi", *aggregates)).over(Window.orderBy("_p"))  # one row for each range
    out = rows.join(F.broadcast(summed.select("_p", before.alias("_passed"))), "_p")
    return out.withColumns({n: F.when(F.col("_passed._hi").eqNullSafe(_key(keys)), F.col("_passed")[n]) for n in aggregates}).drop("_passed")


def with_halo(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Rows of :func:`in_order` and, marked by ``_halo``, the ``n`` rows of its first key that stand before each range.

    A range has a row at least, so the ``n`` rows before one are among the last ``n`` of each of the ``n`` ranges before.
    """
    place = F.row_number().over(Window.orderBy("_p"))  # one row for each range
    numbered = rows.join(F.broadcast(_last_keys(rows, keys).withColumn("_r", place)), "_p")
    back = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*[F.desc(c) for c in order]))
    tails = numbered.where(_key(keys).eqNullSafe(F.col("_hi"))).withColumn("_back", back).where(F.col("_back") <= n)
    halo = tails.withColumn("_r", F.explode(F.sequence(F.col("_r") + 1, F.col("_r") + n)))
    own = numbered.select(*rows.columns, F.lit(False).alias("_halo"), "_r")
    return own.unionByName(halo.select(*rows.columns, F.lit(True).alias("_halo"), "_r")).drop("_p").withColumnRenamed("_r", "_p")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row among those of its keys, from 0; a column of that name is replaced."""
    rows = with_carry(in_order(df.drop(name), keys, order), keys, {"_passed_rows": F.count("*")}, F.sum)
    place = F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)) - 1
    return rows.withColumn(name, F.coalesce("_passed_rows", F.lit(0)) + place).drop("_passed_rows", "_p")
