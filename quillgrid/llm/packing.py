"""Filling fixed-capacity containers with items of varying length (problem 7).

Planning sees only a histogram: how many items have each length. Its size is bounded by the capacity, not by the
data, so best-fit runs over counts on the driver, and its plan is a few ranges for each length. Items then take the
planned slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window, functions as F

from quillgrid.plans.materialize import materialize

CAPACITY = 2048
PLAN_SCHEMA = "length bigint, from_rank bigint, n bigint, first_container bigint"


def plan_slots(histogram: dict[int, int], capacity: int, first_container: int = 0) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, from_rank, n, first_container).

    The items of a length with ranks from_rank .. from_rank + n - 1 go, in this order, one each to the containers
    first_container, first_container + 1, ... Lengths come longest first; each takes the open containers with the
    least room that still fits, whole ranges at a time, and opens new ones when none fits.
    """
    open_ranges: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first container, number)
    rooms: list[int] = []
    plan, fresh = [], first_container

    def put(room: int, start: int, n: int) -> None:
        if room not in open_ranges:
            bisect.insort(rooms, room)
        open_ranges.setdefault(room, []).append((start, n))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, n = open_ranges[room].pop()
                if not open_ranges[room]:
                    del open_ranges[room], rooms[at]
            else:
                # so many new containers that each takes as many items of this length as fit
                room, start, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            used = min(n, left)
            plan.append((length, rank, used, start))
            rank, left = rank + used, left - used
            if n > used:
                put(room, start + used, n - used)
            if room > length:
                put(room - length, start, used)
    return plan


def split_pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, from_token, length): documents longer than a container become full pieces and a rest.

    A document without tokens keeps one piece of length 0.
    """
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    pieces = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("int")
    out = sizes.select("doc_id", n.alias("n_tokens"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("bigint") * capacity
    return out.select("doc_id", "piece_no", start.alias("from_token"), F.least(F.col("n_tokens") - start, F.lit(capacity).cast("bigint")).alias("length"), "n_tokens")


def ranked_within_length(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, counted from 0 within each length, written to the shared folder.

    Rows are range-partitioned by (length, doc_id, piece_no), so one length of a third of all rows spreads over many
    tasks. Ranks within a partition are made up by the number of rows of that length in earlier partitions, a table of
    at most partitions + lengths rows.
    """
    # written first: range partitioning samples its input, which would count all tokens twice
    ordered = materialize(pieces, "pieces").repartitionByRange("length", "doc_id", "piece_no").withColumn("part", F.spark_partition_id())
    local = materialize(ordered.sortWithinPartitions("length", "doc_id", "piece_no"), "packing")
    sizes = local.groupBy("length", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece_no")) - 1
    return local.withColumn("_r", inside).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("_r")).drop("_r", "base", "part")


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Assign every document to containers: (doc_id, piece_no, from_token, length, n_tokens, container_id).

    ``sizes`` has (doc_id, n_tokens). Documents of at most ``capacity`` tokens are never split; longer ones fill
    containers of their own and their rest is packed like any document. A document without tokens (null included)
    has one row of length 0 and no container. Rows with a null doc_id or a repeated one are packed like others.
    """
    spark = sizes.sparkSession
    ranked = materialize(ranked_within_length(split_pieces(sizes, capacity)), "ranked")
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    plan = spark.createDataFrame(plan_slots(histogram, capacity), PLAN_SCHEMA)
    # a few ranges for each length: bounded by the capacity alone, whatever the number of rows
    slots = F.broadcast(plan)
    taken = ranked.join(slots, (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["from_rank"]) & (ranked["rank"] < slots["from_rank"] + slots["n"]), "left")
    return taken.select("doc_id", "piece_no", "from_token", ranked["length"], "n_tokens", (F.col("first_container") + F.col("rank") - F.col("from_rank")).alias("container_id"))


def split_documents(packed: DataFrame) -> DataFrame:
    """(doc_id): documents that were longer than a container, known by a slot planned for their second piece."""
    return packed.where("piece_no = 1 and container_id is not null").select("doc_id").distinct()


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, pieces, tokens, unused) of each container."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
    return used.withColumn("unused", F.lit(capacity) - F.col("tokens"))
