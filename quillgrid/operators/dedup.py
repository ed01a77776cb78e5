"""Exact and order-dependent deduplication of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.functions import text as X
from quillgrid.operators.graph import connected_components, first_accepted
from quillgrid.operators.relational import join_null_safe
from quillgrid.plans.materialize import materialize


def keep_best(df: DataFrame, keys: list[str], score: Column, tie: list[str]) -> DataFrame:
    """One row for each combination of ``keys``: the one of the highest score, ties by the smallest ``tie`` values.

    The best row is an aggregate with map-side combining, so copies of any number cost one row for each task. A null
    score comes last; null keys form a group like any value.
    """
    others = [c for c in df.columns if c not in keys]
    order = F.struct(F.coalesce(-score.cast("double"), F.lit(float("inf"))).alias("s"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in df.columns])


def exact_groups(df: DataFrame, content: str, id_col: str) -> DataFrame:
    """(digest, first_id, copies) of non-null contents; the digest is SHA-256 and its length is part of the key, so
    different texts don't share a group."""
    rows = df.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("digest"), F.length(content).alias("size"), id_col)
    return rows.groupBy("digest", "size").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")).drop("size")


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return keep_best(df, keys, F.lit(0), order)


def dedup_metrics(groups: DataFrame) -> DataFrame:
    """(original, kept, removed, ratio) of groups with ``copies``."""
    out = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("original"), F.count("*").alias("kept"))
    return out.select("original", "kept", (F.col("original") - F.col("kept")).alias("removed"), F.when(F.col("original") > 0, (F.col("original") - F.col("kept")) / F.col("original")).otherwise(0.0).alias("ratio"))


def text_quality(text: Column) -> Column:
    """A score of a text for choosing among copies: logarithm of its length, code, request methods and clear words."""
    low = F.lower(text)
    code = F.least(F.regexp_count(text, F.lit("```")) * F.lit(0.5), F.lit(2.0))
    calls = F.least(F.regexp_count(text, F.lit("GET|POST|PUT|DELETE")) * F.lit(0.2), F.lit(1.0))
    clear = F.least(X.count_of(low, "example") * F.lit(0.3), F.lit(1.5))
    return F.log10(F.length(text) + 1) + code + calls + clear


def word_sets(df: DataFrame, block: list[str], id_col: str, words: Column) -> DataFrame:
    """(*block, id, words, class_id): rows with a non-empty set of words; ``class_id`` is the smallest id of the rows of
    the block that have the same set. Null ids and empty sets have no row."""
    rows = df.where(F.col(id_col).isNotNull()).select(*block, F.col(id_col).alias("id"), F.array_sort(F.array_distinct(words)).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("_h", F.md5(F.array_join("words", "\x01")))  # sets are grouped by a 128-bit hash, not by themselves
    least = rows.groupBy(*block, "_h").agg(F.min("id").alias("class_id"))
    return join_null_safe(rows, least, [*block, "_h"]).select(*block, "id", "words", "class_id")


def similar_classes(sets: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: classes of :func:`word_sets` of one block whose sets are at least so alike (Jaccard),
    exactly. Copies of a set are one class, so a set in a third of all rows makes no pairs with itself.

    Classes meet over the rarest words of their sets (prefix filter): of a set of n words, n - ceil(threshold * n) + 1 are
    posted, in order of frequency over all classes, and sizes must be within the threshold. No pair that is alike is lost
    and no block is compared with itself as a whole.
    """
    rows = materialize(sets.where("id = class_id").select(*block, "id", "words").dropDuplicates([*block, "id"]), "word-sets")
    counts = rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    sized = rows.select(*block, "id", F.size("words").alias("size"), F.explode("words").alias("w")).join(counts, "w")
    place = F.row_number().over(Window.partitionBy(*block, "id").orderBy("n", "w"))
    prefix = sized.withColumn("at", place).where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1)
    left = prefix.select(*block, "w", F.col("id").alias("a"), F.col("size").alias("na"))
    right = prefix.select(*block, "w", F.col("id").alias("b"), F.col("size").alias("nb"))
    near = (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - F.lit(1e-9)) & (F.col("a") < F.col("b"))
    pairs = left.join(right, [*block, "w"]).where(near).select("a", "b").distinct()
    sides = rows.select("id", "words")
    both = pairs.join(sides.toDF("a", "wa"), "a").join(sides.toDF("b", "wb"), "b")
    return both.select("a", "b", X.jaccard(F.col("wa"), F.col("wb")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def space_words(text: Column) -> Column:
    """The lower-cased words of a text between white space; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), X.SPACE), lambda w: w != "")


def word_shingles(text: Column, n: int = 5) -> Column:
    """Runs of ``n`` words of :func:`space_words`; a text of fewer words has one run of all of them, one of none has none."""
    start = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
    runs = X.let(space_words(text), lambda w: F.transform(start(w), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))
    return F.filter(runs, lambda x: x != "")


def similar_pairs(df: DataFrame, block: list[str], id_col: str, text: str, threshold: float) -> DataFrame:
    """:func:`similar_classes` of the texts' words; ids of pairs are those of classes of equal sets."""
    return similar_classes(word_sets(df, block, id_col, space_words(F.col(text))), block, threshold)


def similar_groups(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): members of groups of two or more that equal sets and links (a, b) hold together, directly or
    through others; the component is the smallest id."""
    of_class = connected_components(links).select(F.col("node").alias("class_id"), "component")
    out = sets.select("id", "class_id").distinct().join(of_class, "class_id", "left").select("id", F.coalesce("component", "class_id").alias("component"))
    large = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return out.join(large, "component").select("id", "component")


def representatives(df: DataFrame, groups: DataFrame, id_col: str, score: Column) -> DataFrame:
    """``df`` without the members of groups (id, component) that another member beats: the highest score stays, ties by
    the smaller id; rows outside all groups stay. Only scores are grouped; rows are joined to what leaves."""
    scored = df.select(F.col(id_col).alias("id"), score.alias("score")).join(groups, "id")
    best = scored.groupBy("component").agg(F.max("score").alias("top"))
    first = scored.join(best, "component").where("score = top").groupBy("component").agg(F.min("id").alias("id"))
    beaten = groups.join(first, ["component", "id"], "left_anti").select(F.col("id").alias(id_col)).distinct()
    return df.join(beaten, id_col, "left_anti")


def keep_diverse(df: DataFrame, group: list[str], order: str, text: str, most_alike: float = 0.5) -> DataFrame:
    """Rows kept when, taken by ``order`` within each group, their words are no more than ``most_alike`` (Jaccard) like
    those of any row kept before in the group.

    Alike pairs of a group come from the prefix-filter join, and rows are decided in rounds over these links, so a group
    of a third of all rows is no single task. Null and wordless texts are dropped; equal orders are taken by text, and of
    equal sets the first one stands for all. Rows with a null in ``group`` are alike none.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\w+"), F.lit(0))
    rows = df.where(F.col(text).isNotNull()).select(*group, F.struct(F.col(order).alias("o"), F.col(text).alias("t")).alias("turn"), words.alias("_w")).where(F.size("_w") > 0)
    sets = rows.groupBy(*group, F.array_sort(F.array_distinct("_w")).alias("words")).agg(F.min("turn").alias("turn"))
    nodes = materialize(sets.select(F.monotonically_increasing_id().alias("id"), *group, "words", "turn"), "diverse")
    pairs = materialize(similar_classes(nodes.withColumn("class_id", F.col("id")), group, most_alike).where(F.col("similarity") > most_alike), "alike")
    turn = nodes.select("id", "turn")
    both = pairs.join(turn.toDF("a", "ta"), "a").join(turn.toDF("b", "tb"), "b")
    later = F.col("ta") > F.col("tb")
    earlier = materialize(both.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("before")), "earlier")
    refused = first_accepted(earlier.select("node").union(earlier.select("before")), earlier).where("not accepted").select(F.col("node").alias("id"))
    kept = nodes.join(refused, "id", "left_anti")
    return kept.select(*group, F.col("turn.o").alias(order), F.col("turn.t").alias(text))


def entry_cascade(df: DataFrame, library: str, entry_id: str) -> DataFrame:
    """Entries kept when, taken by id within their library, they repeat no entry kept before: the same content, a title
    more than 0.9 alike, for code contents more than 0.8 alike, for others title and description more than 0.8 alike.

    Of entries with equal sets of words the first stands for all: others are compared with it, not with each copy. The
    links come from joins over hashes and over rare words, and rows are decided in rounds over them, so a library of a
    third of all rows is no single task. Rows with a null id or library are kept.
    """
    rows = df.where(F.col(entry_id).isNotNull() & F.col(library).isNotNull())
    code = F.coalesce(F.col("entry_type") == "code_snippet", F.lit(False)) | F.coalesce(F.col("content").contains("```"), F.lit(False))
    both = F.concat_ws(" ", "title", "description")
    chosen = [(F.lit(True), F.col("title"), 0.9), (code, F.col("content"), 0.8), (~code, both, 0.8)]
    links = None
    for cond, text, least in chosen:
        sets = materialize(word_sets(rows.where(cond), [library], entry_id, space_words(text)), "sets")
        alike = similar_classes(sets, [library], least).where(F.col("similarity") > least).select("a", "b")
        member = sets.select("id", "class_id")
        # members of alike classes are linked through their classes: each to the other's first, and to its own
        pairs = alike.join(member.toDF("x", "a"), "a").select("x", F.col("b").alias("y")).union(alike.join(member.toDF("x", "b"), "b").select("x", F.col("a").alias("y"))).union(member.where("id <> class_id").toDF("x", "y"))
        links = pairs if links is None else links.union(pairs)
    same = rows.where("content is not null").select(F.col(entry_id).alias("x"), library, F.sha2("content", 256).alias("h"))
    first = same.groupBy(library, "h").agg(F.min("x").alias("y"))
    links = links.union(same.join(first, [library, "h"]).where("x <> y").select("x", "y"))
    earlier = materialize(links.select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("before")).where("node <> before").distinct(), "earlier")
    refused = first_accepted(earlier.select("node").union(earlier.select("before")), earlier, node_type=rows.schema[entry_id].dataType.simpleString()).where("not accepted").select(F.col("node").alias(entry_id))
    return df.join(refused, entry_id, "left_anti")
