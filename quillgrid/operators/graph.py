"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillgrid.plans.materialize import drop_scratch, materialize

#: Links of a component that one task may decide in order.
COMPONENT_LINKS = 10_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node hands the smallest of its neighbourhood to its larger (or its other) neighbours.

    Only minima are aggregated, with map-side combining, and joined back; no neighbourhood is ever collected, so a
    node with very many neighbours is split by the skew join instead of filling one task.
    """
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    pairs = around.join(least, "a")
    if large:
        out = pairs.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = pairs.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Components of the undirected graph given by ``edges``: one row (node, component) for each node of an edge.

    ``component`` is the smallest node of its component. Rows with a null end and self-loops are dropped; repeated
    edges count once; an empty edge table gives an empty result. Converges in O(log^2 n) rounds, each written to the
    shared folder; raises RuntimeError when ``max_rounds`` doesn't suffice, never returns a partial answer.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        after = materialize(_star(_star(now, large=True), large=False), "cc")
        sign = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop_scratch(now)
        now = after
        if sign == seen:
            roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        seen = sign
    raise RuntimeError(f"components need more than {max_rounds} rounds")


def first_accepted(nodes: DataFrame, earlier: DataFrame, rounds: int = 12, small: int | None = None, node_type: str = "bigint") -> DataFrame:
    """(node, accepted) when nodes are taken in order and one is accepted unless an earlier accepted one is alike.

    ``earlier`` has (node, before): alike pairs of undecided nodes. Each round decides every node whose earlier
    neighbours are all decided or of which one has been accepted. What is still open after ``rounds`` (long chains) is
    cut into components; those of at most ``small`` links are decided by one task each, larger ones by more rounds.
    """
    small = COMPONENT_LINKS if small is None else small
    state = materialize(nodes.select("node").distinct().withColumn("accepted", F.lit(None).cast("boolean")), "decisions")
    n = 0
    while not state.where("accepted is null").isEmpty():
        n += 1
        if n == rounds + 1:
            state = _decide_components(state, earlier, small, node_type)
            continue
        seen = earlier.join(state.select(F.col("node").alias("before"), F.col("accepted").alias("b")), "before")
        told = seen.groupBy("node").agg(F.max(F.coalesce("b", F.lit(False))).alias("hit"), F.max(F.col("b").isNull()).alias("open"))
        decided = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(F.col("hit"), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        after = materialize(state.join(told, "node", "left").select("node", decided.alias("accepted")), "decisions")
        drop_scratch(state)
        state = after
    return state


def _decide_components(state: DataFrame, earlier: DataFrame, small: int, node_type: str) -> DataFrame:
    """Decide the components of open nodes that have at most ``small`` links, each in one task."""
    known = state.select(F.col("node").alias("before"), F.col("accepted").alias("b"))
    hit = earlier.join(known.where("b"), "before").select("node").distinct().withColumn("hit", F.lit(True))
    waiting = materialize(state.where("accepted is null").select("node").join(hit, "node", "left").select("node", F.col("hit").isNotNull().alias("hit")), "waiting")
    open_links = earlier.join(waiting, "node").join(waiting.toDF("before", "hit_before"), "before").select("node", "before", "hit", "hit_before")
    open_links = materialize(open_links, "open-links")
    component = connected_components(open_links, "node", "before")
    linked = open_links.join(component, "node")
    few = linked.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= small).select("component")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        before: dict[int, list[int]] = {}
        after: dict[int, list[int]] = {}
        beaten = {*pdf.loc[pdf["hit"], "node"].tolist(), *pdf.loc[pdf["hit_before"], "before"].tolist()}
        for a, b in zip(pdf["node"].tolist(), pdf["before"].tolist()):
            before.setdefault(a, []).append(b)
            after.setdefault(b, []).append(a)
        waiting = {a: len(bs) for a, bs in before.items()}
        ready, told = [b for b in after if b not in before], {}
        while ready:
            node = ready.pop()
            told[node] = node not in beaten and not any(told[b] for b in before.get(node, ()))
            for a in after.get(node, ()):
                waiting[a] -= 1
                if not waiting[a]:
                    ready.append(a)
        return pd.DataFrame({"node": list(told), "told": list(told.values())})

    done = linked.join(few, "component").select("component", "node", "before", "hit", "hit_before").groupBy("component").applyInPandas(decide, f"node {node_type}, told boolean")
    return materialize(state.join(done, "node", "left").select("node", F.coalesce("accepted", "told").alias("accepted")), "decisions")
