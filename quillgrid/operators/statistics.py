"""Statistics over logs and tables: percentiles, trends, histograms, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.operators.ordered import in_order, with_carry, with_halo, within
from quillgrid.operators.relational import join_null_safe


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(*keys, n, name...): the value at index int(n * share) of the sorted values, for each named share; exact.

    Null values are left out.
    """
    ranks = {name: (s, lambda n, s=s: F.least(F.floor(n * F.lit(float(s))), n - 1)) for name, s in shares.items()}
    return values_at(df, keys, value, ranks, accuracy)


def median(df: DataFrame, keys: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """(*keys, n, median): the middle value, or the mean of the two; exact. Null values are left out."""
    both = values_at(df, keys, value, {"_lo": (0.5, lambda n: F.floor((n - 1) / 2)), "_hi": (0.5, lambda n: F.ceil((n - 1) / 2))}, accuracy)
    return both.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def values_at(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]], accuracy: int) -> DataFrame:
    """(*keys, n, name...): for each name a share and the index near it, told from n, of the value to take.

    Sketches with map-side merging bracket each rank by two values; what lies below the bracket is counted, and only
    values inside it (a few of ``accuracy`` parts of a key's rows, equal values combined) are put in order. So a key of
    a third of all rows is never sorted as a whole.
    """
    names, rows = list(ranks), df.where(F.col(value).isNotNull()).select(*keys, value)
    edges = [min(1.0, max(0.0, s + d)) for s, _ in ranks.values() for d in (-2 / accuracy, 2 / accuracy)]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(value, edges, accuracy).alias("_e"))
    near = join_null_safe(rows, found, keys)
    inside = F.array_compact(F.array(*[F.when(F.col(value).between(F.col("_e")[2 * i], F.col("_e")[2 * i + 1]), F.lit(i)) for i in range(len(names))]))
    below = near.groupBy(*keys).agg(F.max("n").alias("n"), *[F.sum((F.col(value) < F.col("_e")[2 * i]).cast("bigint")).alias(f"_b{i}") for i in range(len(names))])
    counted = near.where(F.size(inside) > 0).groupBy(*keys, value).agg(F.count("*").alias("_c"), F.first(inside).alias("_in"))
    exploded = counted.select(*keys, value, "_c", F.explode("_in").alias("_i"))
    joined = join_null_safe(exploded, below, keys).withColumn("_b", F.array(*[F.col(f"_b{i}") for i in range(len(names))]))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(value))
    wanted = F.array(*[index(F.col("n")) for _, index in ranks.values()])[F.col("_i")]
    hit = joined.withColumn("_to", F.col("_b")[F.col("_i")] + upto).where((F.col("_to") > wanted) & (F.col("_to") - F.col("_c") <= wanted))
    return hit.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_i") == i, F.col(value))).alias(name) for i, name in enumerate(names)])


def approximate_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """The same from mergeable sketches, for keys whose values don't fit a sort."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.percentile_approx(value, s, accuracy).alias(name) for name, s in shares.items()])


def rates(df: DataFrame, keys: list[str], outcomes: dict[str, Column]) -> DataFrame:
    """(*keys, n, name_n, name_rate...): how many rows meet each condition, and their share."""
    parts = []
    for name, cond in outcomes.items():
        hit = F.sum(F.when(cond, 1).otherwise(0))
        parts += [hit.alias(f"{name}_n"), (hit / F.count("*")).alias(f"{name}_rate")]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *parts)


def value_shares(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share): counts of each value and their part of all; the total is joined as one row."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("_total")).alias("share"))


def pivot_counts(df: DataFrame, key: str, value: str, domain: list[str]) -> DataFrame:
    """(key, one column for each value of the domain): counts with zeros where there is none."""
    return df.groupBy(key).agg(*[F.sum(F.when(F.col(value) == v, 1).otherwise(0)).alias(v) for v in domain])


def numeric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def running_mean(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with the mean of each key's values so far as ``running_mean``; nulls don't count, null keys are one key."""
    rows = with_carry(in_order(df.drop("running_mean"), keys, order), keys, {"_sum": F.sum(value), "_n": F.count(value)}, F.sum)
    w = within(keys, order)
    total = F.coalesce("_sum", F.lit(0)) + F.coalesce(F.sum(value).over(w), F.lit(0))
    n = F.coalesce("_n", F.lit(0)) + F.count(value).over(w)
    return rows.withColumn("running_mean", F.when(n > 0, total / n)).drop("_sum", "_n", "_p")


def last_n(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Mean and maximum of the last ``n`` values, the current one included."""
    rows = in_order(df, keys, order)
    rows = with_halo(rows, keys, order, n - 1) if n > 1 else rows.withColumn("_halo", F.lit(False))
    w = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("last_mean", F.avg(value).over(w)).withColumn("last_max", F.max(value).over(w)).where("not _halo").drop("_halo", "_p")


def trend(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10, flat: float = 0.1) -> DataFrame:
    """Slope of the least-squares line through each key's last ``n`` values, and its name; stable without a slope."""
    recent = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = df.withColumn("_i", F.row_number().over(recent)).where(F.col("_i") <= n)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.col(value), -F.col("_i").cast("double")).alias("slope"))
    return out.withColumn("trend", F.when(F.col("slope") > flat, "increasing").when(F.col("slope") < -flat, "decreasing").otherwise("stable"))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, keep: float = 0.8) -> DataFrame:
    """(*keys, n, ema): the exponential average of each key's values in order, begun with the first.

    The fold needs the order, so it is a weighted sum: the weight of a value depends only on how many come after it.
    """
    rows = in_order(df.where(F.col(value).isNotNull()).select(*keys, value, F.col(order).alias("_o")), keys, ["_o"])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    placed = with_carry(rows, keys, {"_c": F.count("*")}, F.sum).withColumn("_i", F.coalesce("_c", F.lit(0)) + F.row_number().over(Window.partitionBy("_p", *keys).orderBy("_o")))
    weight = F.pow(F.lit(keep), F.col("n") - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(1 - keep)
    return join_null_safe(placed, sizes, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.sum(weight * F.col(value)).alias("ema"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, n): values by bins of one width; null values are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def histogram_texts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, values, histogram, repeated): how many distinct values, each with its number as a=2,b=1, and those met more
    than once. Values are counted before they are gathered, so a list holds distinct ones only; meant for small domains."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    lists = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("v"), "_n"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: F.concat(x["v"], F.lit("="), x["_n"].cast("string"))), ",")
    often = F.array_join(F.transform(F.filter("_l", lambda x: x["_n"] > 1), lambda x: x["v"]), ",")
    return lists.select(*keys, F.size("_l").alias("values"), text.alias("histogram"), often.alias("repeated"))
