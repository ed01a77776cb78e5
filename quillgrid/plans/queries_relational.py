"""Relational queries: joins, grouping sets, set operations, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgrid.operators import relational as R
from quillgrid.plans.registry import query, table


@query("""SELECT c_mktsegment, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2""")
def revenue_by_segment(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    li = t("lineitem").where(F.col("l_shipdate") >= "1995-01-01").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("money"))
    per_order = li.groupBy("l_orderkey").agg(F.sum("money").alias("money"))
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_mktsegment", "r_name")
    rows = per_order.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment", "r_name").agg(F.round(F.sum("money"), 2).alias("revenue"), F.count("*").alias("orders"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= "1998-09-02")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 200000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority like '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def customers_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.rollup("r_name", "n_name").agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT p_brand, p_type, count(*) AS parts, max(p_retailprice) AS dearest FROM part GROUP BY CUBE (p_brand, p_type)")
def parts_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").cube("p_brand", "p_type").agg(F.count("*").alias("parts"), F.max("p_retailprice").alias("dearest"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def orders_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("quillgrid_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM quillgrid_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey").distinct()).distinct()


@query("SELECT doc_id AS id, library_id FROM documents UNION ALL SELECT cache_id, NULL FROM embedding_cache")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "library_id").unionByName(table(spark, d, "embedding_cache").select(F.col("cache_id").alias("id")), allowMissingColumns=True)


@query("SELECT e.event_id, j.event_id AS error_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1, 2) j ON e.user_id = j.user_id AND e.ts >= j.ts")
def last_error_before(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    errors = rows.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return R.as_of_join(rows.select("user_id", "event_id", "ts"), errors, ["user_id"], "ts", "error_ts", ["error_id"]).select("event_id", "error_id")


@query("""WITH w AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b, event_id AS purchase_id FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, w.purchase_id FROM events e JOIN w ON e.user_id = w.user_id AND epoch_us(e.ts) >= w.a AND epoch_us(e.ts) < w.b""")
def hour_after_purchase(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    windows = rows.where("event_type = 'purchase'").select("user_id", F.col("at").alias("a"), (F.col("at") + 3_600_000_000).alias("b"), F.col("event_id").alias("purchase_id"))
    return R.interval_join(rows.select("user_id", "event_id", "at"), windows, ["user_id"], "at", "a", "b", 3.6e9).select("event_id", "purchase_id")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45")
def salted_part_join(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return R.salted_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, ["l_partkey"]).select("l_orderkey", "l_linenumber", "p_name")


@query("""WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true)::int AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::bigint AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY 1, 2""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return R.gaps_and_islands(table(spark, d, "events"), ["user_id"], "ts", 1800)


@query("SELECT library_id, l.category, count(*) AS chunks, round(avg(d.trust_score - l.trust_score), 6) AS drift FROM document_embedding d JOIN library_info l USING (library_id) GROUP BY 1, 2")
def chunks_by_category(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "library_info").select("library_id", "category", F.col("trust_score").alias("known"))
    rows = table(spark, d, "document_embedding").select("library_id", "trust_score").join(info, "library_id")
    return rows.groupBy("library_id", "category").agg(F.count("*").alias("chunks"), F.round(F.avg(F.col("trust_score") - F.col("known")), 6).alias("drift"))


@query("WITH e AS (SELECT content_hash, count(*) AS entries FROM documentation_entry GROUP BY 1), c AS (SELECT content_hash, count(*) AS cached FROM embedding_cache GROUP BY 1) SELECT content_hash, coalesce(entries, 0) AS entries, coalesce(cached, 0) AS cached FROM e FULL JOIN c USING (content_hash)")
def hashes_both_sides(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documentation_entry").groupBy("content_hash").agg(F.count("*").alias("entries"))
    c = table(spark, d, "embedding_cache").groupBy("content_hash").agg(F.count("*").alias("cached"))
    out = e.join(c, "content_hash", "full_outer")
    return out.select("content_hash", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("cached", F.lit(0)).alias("cached"))
