"""Roll-ups over logs of jobs, events and stored texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.plans.materialize import materialize

# States of a job from the best to the worst.
SEVERITY = ("completed", "queued", "processing", "retrying", "failed")


def worst_state(df: DataFrame, keys: list[str], state: str, order: tuple[str, ...] = SEVERITY) -> DataFrame:
    """(*keys, worst, n, ...one count for each state): the worst state of each key wins; unknown states count as worse than
    all, under "unknown"."""
    rank = F.coalesce(reduce(lambda a, i: a.when(F.col(state) == order[i], i), range(1, len(order)), F.when(F.col(state) == order[0], 0)), F.lit(len(order)))
    names = F.array(*[F.lit(x) for x in (*order, "unknown")])
    return df.groupBy(*keys).agg(F.max(rank).alias("_r"), F.count("*").alias("n"), *[F.sum((rank == i).cast("bigint")).alias(x) for i, x in enumerate(order)]).select(*keys, names[F.col("_r")].alias("worst"), "n", *order)


def coverage(tokens: Column, expected: Column) -> Column:
    """Per cent of what was expected, 100 at most; null where nothing was."""
    return F.least(F.try_divide(tokens * 100.0, expected), F.lit(100.0))


def saved(before: Column, after: Column) -> dict[str, Column]:
    """What a smaller form saves: bytes, their share of the whole, and how many times smaller it is."""
    return {"saved": before - after, "share": F.try_divide((before - after).cast("double"), before), "factor": F.try_divide(before.cast("double"), after)}


def best_by(df: DataFrame, keys: list[str], choice: str, score: Column, least: int = 1) -> DataFrame:
    """(*keys, choice, score): the value of ``choice`` whose rows have the highest mean score, of those with at least
    ``least`` rows; ties by the smaller value. Means are combined before the shuffle, whatever a value's number of rows."""
    means = df.groupBy(*keys, choice).agg(F.avg(score).alias("score"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    picked = means.groupBy(*keys).agg(F.min_by(F.struct(choice, "score"), F.struct(-F.col("score"), F.col(choice))).alias("r"))
    return picked.select(*keys, f"r.{choice}", "r.score")


def running_total(df: DataFrame, order: list[str], value: str, name: str = "total") -> DataFrame:
    """Append the sum of ``value`` over all rows up to each one in a total ``order``.

    Rows are range-partitioned, sums run inside each part, and the sums of earlier parts, a table of one row for each
    part, are added: no task has all rows.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "running")
    before = parts.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = before.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_in", inside).join(F.broadcast(before), "_p").withColumn(name, F.col("_base") + F.col("_in")).drop("_p", "_in", "_base")


def peak_concurrency(df: DataFrame, start: str, end: str) -> DataFrame:
    """(peak): how many intervals are open at once at most; one that ends when another starts isn't open with it. Intervals
    without a start are left out; those without an end stay open."""
    rows = df.where(F.col(start).isNotNull())
    steps = rows.select(F.col(start).alias("at"), F.lit(1).alias("step")).union(rows.where(F.col(end).isNotNull()).select(F.col(end), F.lit(-1)))
    counted = steps.groupBy("at", "step").agg(F.sum("step").alias("change"))
    return running_total(counted, ["at", "step"], "change", "open").agg(F.coalesce(F.max("open"), F.lit(0)).alias("peak"))


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """A mean by weights; weights that don't add up to 1 raise."""
    if abs(sum(w for _, w in parts.values()) - 1) > 1e-9:
        raise ValueError("weights add up to 1")
    return reduce(lambda a, b: a + b, [c * w for c, w in parts.values()])


def longest(df: DataFrame, keys: list[str], text: str, n: int) -> DataFrame:
    """The ``n`` longest texts of each key with their ``place``, ties by text; Spark keeps n rows of a key in each task."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.length(text)), text)
    return df.where(F.col(text).isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def touched(table: DataFrame, requests: DataFrame, key: str, counter: str, accessed: str, at: str) -> DataFrame:
    """``table`` with ``counter`` raised by how often its key was requested and ``accessed`` moved to the last request;
    requests are combined before they meet the table."""
    asked = requests.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.max(at).alias("_at"))
    out = table.join(asked, table[key] == F.col("_k"), "left")
    return out.withColumns({counter: F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0)), accessed: F.greatest(accessed, "_at")}).drop("_k", "_n", "_at")
