"""Running values over keys that spread over many ranges, against plain Python: hot keys, null keys, nulls, ties, empty tables."""

import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import enrich, ordered, relational, statistics

KEYS = ["hot"] * 8 + ["a", "b", None]


@pytest.fixture(scope="module", autouse=True)
def small_ranges(spark):
    """Ranges of small tables aren't put together again."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(r.choice(KEYS), t * r.choice([1, 1, 1, 40]), n, r.choice([None, *range(20)])) for n, t in enumerate(r.choices(range(900), k=600))]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(k, t, n, None if v is None else float(v)) for k, t, n, v in rows], "k string, t long, n long, v double").repartition(7)


def by_key(rows):
    out = {}
    for k, t, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(k, []).append((t, n, v))
    return out


def test_ranges_split_hot_keys(df):
    parts = ordered.in_order(df, ["k"], ["t", "n"]).where("k = 'hot'").select("_p").distinct().count()
    assert parts > 1


def test_running_mean(df, rows):
    got = {r.n: r.running_mean for r in statistics.running_mean(df, ["k"], ["t", "n"], "v").collect()}
    assert len(got) == len(rows)
    for every in by_key(rows).values():
        seen = []
        for _, n, v in every:
            seen += [v] if v is not None else []
            assert got[n] == (pytest.approx(sum(seen) / len(seen)) if seen else None)


@pytest.mark.parametrize("n", [1, 4, 150])
def test_last_n(df, rows, n):
    out = statistics.last_n(df, ["k"], ["t", "n"], "v", n).collect()
    got = {r.n: (r.last_mean, r.last_max) for r in out}
    assert len(out) == len(rows)
    for every in by_key(rows).values():
        for i, (_, at, _) in enumerate(every):
            seen = [v for _, _, v in every[max(0, i - n + 1) : i + 1] if v is not None]
            assert got[at] == ((pytest.approx(sum(seen) / len(seen)), max(seen)) if seen else (None, None))


def test_moving_average(df, rows):
    got = {r.k: (r.n, r.ema) for r in statistics.moving_average(df.withColumn("o", F.struct("t", "n")), ["k"], "o", "v").collect()}
    for k, every in by_key(rows).items():
        ema, n = None, 0
        for _, _, v in every:
            if v is not None:
                ema, n = (v if ema is None else 0.8 * ema + 0.2 * v), n + 1
        assert got[k] == (n, pytest.approx(ema))


def test_sessions(df, rows):
    timed = df.withColumn("at", F.timestamp_seconds("t"))
    got = {(r.k, r.session, r.n) for r in relational.gaps_and_islands(timed, ["k"], "at", 30).collect()}
    want = set()
    for k, every in by_key(rows).items():
        sizes, last = [], None
        for t, _, _ in every:
            sizes += [0] if last is None or t - last >= 30 else []
            sizes[-1] += 1
            last = t
        want |= {(k, i + 1, n) for i, n in enumerate(sizes)}
    assert got == want


def test_as_of(spark, df, rows):
    right = [(k, t, n) for k, t, n, v in rows if v is not None and v > 17]
    got = {r.n: r.seen for r in relational.as_of_join(df, spark.createDataFrame(right, "k string, u long, seen long"), ["k"], "t", "u", ["seen"]).collect()}
    for k, t, n, _ in rows:
        before = [(u, m) for q, u, m in right if q == k and u <= t]
        assert got[n] == (max(before)[1] if before else None)


def test_median(df, rows):
    got = {r.k: (r.n, r["median"]) for r in statistics.median(df, ["k"], "v").collect()}
    for k, every in by_key(rows).items():
        vs = [v for _, _, v in every if v is not None]
        assert got[k] == (len(vs), plain.median(vs))


def test_empty(df):
    none = df.limit(0)
    assert statistics.running_mean(none, ["k"], ["t"], "v").isEmpty() and statistics.last_n(none, ["k"], ["t"], "v", 3).isEmpty()
    assert statistics.moving_average(none, ["k"], "t", "v").isEmpty() and statistics.median(none, ["k"], "v").isEmpty()
    assert relational.gaps_and_islands(none.withColumn("at", F.timestamp_seconds("t")), ["k"], "at", 5).isEmpty()
    assert relational.as_of_join(none, df.select("k", F.col("t").alias("u"), F.col("n").alias("m")), ["k"], "t", "u", ["m"]).isEmpty()


def test_numbered(df, rows):
    got = {r.n: r.place for r in ordered.numbered(df, ["k"], ["t", "n"], "place").collect()}
    for every in by_key(rows).values():
        assert [got[n] for _, n, _ in every] == list(range(len(every)))
    assert ordered.numbered(df.limit(0), ["k"], ["t"], "place").isEmpty()


def test_histogram_texts(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("a", None), (None, "y"), ("c", None)], "k string, v string")
    got = {tuple(r) for r in statistics.histogram_texts(rows, ["k"], "v").collect()}
    assert got == {("a", 2, "x=2,y=1", "x"), (None, 1, "y=1", "")}
    assert statistics.histogram_texts(rows.limit(0), ["k"], "v").isEmpty()


def test_clamp():
    assert [enrich.clamp(n) for n in (-3, 0, 1, 50, 51)] == [1, 1, 1, 50, 50]
