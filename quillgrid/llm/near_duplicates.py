"""Near-duplicate records with small edits (problem 5): a signature-coordinate inverted join.

Every class of texts with equal sets has a signature of COORDINATES minima. Two alike texts agree in at least
MIN_MATCHES coordinates (at likeness 0.7 fewer are met about four times in ten million pairs). A class is posted under
its COORDINATES - MIN_MATCHES + 1 rarest coordinate-value pairs (the prefix), which is enough for such texts to meet;
the frequent values are skipped. Where two postings meet, the low bits of both whole signatures, which travel with
them, bound the number of collisions from above, and pairs below the match threshold never leave the join. Pairs that
remain are compared exactly.

Posting lists stay short because of the prefix. A posting whose list may have more than HOT_LIST members (known from a
count sketch) goes the other way: all members are compared with the list's smallest one first. Components of all links
found so far then part each list into its largest component and the others; only members of the others are paired, with
members of other components, in salted blocks. Members of the largest component never meet each other, so a list of
near copies costs what it has members, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgrid.llm import canonical, likeness as L, sketch as S
from quillgrid.operators.graph import connected_components
from quillgrid.plans.materialize import materialize

ALIKE = 0.7
MIN_MATCHES = 14
HOT_LIST = 2_000
_SALTS = 16
_CO = np.arange(L.COORDINATES, dtype=np.uint64) << np.uint64(32)


def _coordinate_keys(batch: pa.RecordBatch) -> np.ndarray:
    """The coordinate-value pairs of each signature as 64-bit keys, [rows, COORDINATES]."""
    return L.signature_matrix(batch.column("sig")).astype(np.uint64) | _CO


def text_classes(signed: DataFrame, least: str, after: int = 0, keep: str = "text_hash") -> DataFrame:
    """(node, h1, h2, first, keep, sig): one row for each distinct set, ``first`` the least value of ``least`` and
    ``keep`` that column's value there. Nodes are numbered from ``after`` on.

    Copies are combined before the shuffle. Node numbers are given once and written, so later steps agree on them.
    """
    one = signed.groupBy("h1", "h2").agg(F.min(F.struct(least, keep, "sig")).alias("m"))
    return materialize(one.select((F.monotonically_increasing_id() + F.lit(after)).alias("node"), "h1", "h2", F.col("m")[least].alias("first"), f"m.{keep}", "m.sig"), "classes")


def postings(classes: DataFrame, min_matches: int = MIN_MATCHES, hot_list: int = HOT_LIST, bits: int = S.SKETCH_BITS) -> DataFrame:
    """(key, node, b1, b2, hot): each class under its rarest coordinate-value pairs, with its signature's low bits."""
    spark = classes.sparkSession
    sketch = spark.sparkContext.broadcast(S.count_sketch(classes.select("sig"), _coordinate_keys, bits))  # 2^bits * 4 bytes
    prefix = L.COORDINATES - min_matches + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = L.signature_matrix(batch.column("sig"))
            keys = _coordinate_keys(batch)
            seen = sketch.value[S.slots_of(keys, bits)].astype(np.uint64)
            order = np.argsort((seen << np.uint64(32)) | sig, axis=1, kind="stable")[:, :prefix]
            key = np.take_along_axis(keys, order, 1).astype(np.int64)
            hot = np.take_along_axis(seen, order, 1) > hot_list
            node = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(c, prefix)) for c in (node, *L.packed_bits(sig))), pa.array(hot.ravel())], names=["key", "node", "b1", "b2", "hot"])

    return classes.select("node", "sig").mapInArrow(post, "key bigint, node bigint, b1 bigint, b2 bigint, hot boolean")


def _met(left: DataFrame, right: DataFrame, on: list[str], min_matches: int) -> DataFrame:
    """Distinct pairs (a, b) of postings that meet and may agree in ``min_matches`` coordinates."""
    r = right.select(*on, F.col("node").alias("node_b"), F.col("b1").alias("c1"), F.col("b2").alias("c2"))
    met = left.join(r, on).where(F.col("node") < F.col("node_b")).where(L.possible_agreements(("b1", "b2"), ("c1", "c2")) >= min_matches)
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def compare(pairs: DataFrame, texts: DataFrame, alike: float, texts_b: DataFrame | None = None) -> DataFrame:
    """(a, b, likeness) of the pairs whose texts are alike. ``texts`` has (node, words), for b too where ``texts_b``
    isn't given."""
    other = texts if texts_b is None else texts_b
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a").join(other.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
    return L.exact_likeness(both, ("a", "b"), alike)


def texts_of(pairs: DataFrame, classes: DataFrame, rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(node, words) of the classes in ``pairs``, read from the table by id and text hash of each class's first row."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", F.col("first").alias(row_id), "text_hash"), "node")
    found = rows.where(F.col(row_id).isNotNull()).select(row_id, text, F.xxhash64(text).alias("text_hash")).join(nodes, [row_id, "text_hash"]).dropDuplicates(["node"])
    return materialize(found.select("node", L.words(F.col(text)).alias("words")), "texts")


def alike_classes(classes: DataFrame, rows: DataFrame, row_id: str, text: str, known: DataFrame | None = None, alike: float = ALIKE, min_matches: int = MIN_MATCHES, hot_list: int = HOT_LIST, bits: int = S.SKETCH_BITS) -> DataFrame:
    """(a, b) links between classes: all alike pairs that meet in short lists, and from long lists as many as connect
    all that are connected. ``known`` are further links that count for connection."""
    posted = postings(classes, min_matches, hot_list, bits)
    cold = posted.where("not hot").drop("hot").repartition("key")  # both sides of the join read this one exchange
    hot = materialize(posted.where("hot").drop("hot"), "hot-postings")
    pairs = materialize(_met(cold, cold, ["key"], min_matches), "candidates")
    links = compare(pairs, texts_of(pairs, classes, rows, row_id, text), alike).select("a", "b")
    links = links if known is None else links.union(known.select("a", "b"))
    if hot.isEmpty():
        return links
    return links.unionByName(_hot_links(hot, materialize(links, "links"), classes, rows, row_id, text, alike, min_matches))


def _hot_links(hot: DataFrame, links: DataFrame, classes: DataFrame, rows: DataFrame, row_id: str, text: str, alike: float, min_matches: int) -> DataFrame:
    """Links from long lists: first with each list's smallest member, then between members still apart."""
    lead = hot.groupBy("key").agg(F.min(F.struct("node", "b1", "b2")).alias("m")).select("key", "m.*")
    stars = materialize(_met(lead, hot, ["key"], min_matches), "stars")
    found = materialize(compare(stars, texts_of(stars, classes, rows, row_id, text), alike).select("a", "b"), "star-links")
    rest = materialize(apart(hot, connected_components(links.union(found)), min_matches), "apart")
    return found.union(compare(rest, texts_of(rest, classes, rows, row_id, text), alike).select("a", "b"))


def apart(hot: DataFrame, components: DataFrame, min_matches: int) -> DataFrame:
    """(a, b): members of a list in different components that may agree in enough coordinates.

    One side of each pair is outside the list's largest component; the sides are spread over salts, so a list of a
    third of all rows isn't one task.
    """
    label = components.select("node", F.col("component").alias("label"))
    labelled = hot.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("m.label").alias("largest"))
    open_lists = materialize(labelled.join(largest, "key"), "open-lists")
    left = open_lists.where("label <> largest").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int"))
    right = open_lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    r = right.select("key", "salt", F.col("node").alias("node_b"), F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("label").alias("label_b"), F.col("largest").alias("largest_b"))
    # a pair of two members outside the largest component is formed once
    once = (F.col("label_b") == F.col("largest_b")) | (F.col("node") < F.col("node_b"))
    met = left.join(r, ["key", "salt"]).where((F.col("label") != F.col("label_b")) & once).where(L.possible_agreements(("b1", "b2"), ("c1", "c2")) >= min_matches)
    return met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def near_duplicate_groups(df: DataFrame, entry_id: str = "entry_id", title: str = "title", content: str = "content", alike: float = ALIKE) -> DataFrame:
    """(id, class_id, group_id) of every entry with a non-blank content that has any letter or digit.

    ``class_id`` is the smallest id among texts with the same set, ``group_id`` the smallest among all that are alike,
    directly or through others, or that are the same but for formatting (problem 1). Texts of one or two words are
    alike only when their words are the same. Null ids have no row; the empty table gives an empty result.
    """
    rows = df.where(F.col(entry_id).isNotNull()).select(entry_id, title, content)
    keyed = canonical.with_canonical_keys(rows, title, content)
    keyed = keyed.withColumn("text_hash", F.xxhash64(content))
    signed = materialize(L.with_signatures(keyed, content, (entry_id, "text_hash", "flat", "ordered"), L.COORDINATES), "signed")
    classes = text_classes(signed, entry_id)
    members = materialize(signed.join(classes.select("h1", "h2", "node", "first"), ["h1", "h2"]).select(F.col(entry_id).alias("id"), "flat", "ordered", "node", F.col("first").alias("class_id")), "members")
    same = members.where("flat is not null").select("node", F.explode(F.array("flat", "ordered")).alias("k")).distinct()
    lead = same.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("k", "a")
    formatting = same.join(lead, "k").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    links = alike_classes(classes, rows, entry_id, content, formatting, alike)
    component = connected_components(links).join(classes.select("node", "first"), "node")
    least = component.groupBy("component").agg(F.min("first").alias("group_id"))
    of_node = component.join(least, "component").select("node", "group_id")
    return members.join(of_node, "node", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))


def groups_found(groups: DataFrame) -> DataFrame:
    """(group_id, entry_id) of each member of a group of two or more distinct ids, its first included."""
    big = groups.groupBy("group_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("group_id")
    return groups.join(big, "group_id").select("group_id", F.col("id").alias("entry_id")).distinct()
