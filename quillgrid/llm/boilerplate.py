"""Lines repeated across the documents of one library (problem 3).

Per library a weighted graph is built: its nodes are lines with the number of distinct documents that have them, its
edges consecutive lines with the number of documents in which they follow each other. Nodes and edges of high support
stay; connected components of what stays are the library's boilerplate blocks, and their occurrences are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillgrid.operators.graph import connected_components
from quillgrid.plans.materialize import materialize

MIN_LETTERS = 15
MIN_DOCUMENTS = 12
MIN_SHARE = 0.1


def line_keys(content: Column, min_letters: int = MIN_LETTERS) -> Column:
    """An array with one element for each line, split at newlines: a struct of two hashes of its upper-cased letters
    (96 bits), or null where the line has fewer than ``min_letters`` of them."""
    letters = F.split(F.regexp_replace(F.upper(content), r"[^\p{L}\n]+", ""), "\n")
    return F.transform(letters, lambda x: F.when(F.length(x) >= min_letters, F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"))))


def latest_documents(df: DataFrame, doc_id: str, library: str, content: str, version: str | None) -> DataFrame:
    """(id, library_id, lines) once for each distinct id: its row of the latest ``version``, ties by the greater key.

    Null ids and null libraries are dropped; a null or empty content has no key lines but its id counts.
    """
    rows = df.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"),
        F.col(library).alias("library_id"),
        (F.col(version) if version else F.lit(0)).alias("at"),
        line_keys(F.col(content)).alias("lines"),
    )
    best = rows.groupBy("id").agg(F.max_by(F.struct("library_id", "lines"), F.struct("at", F.xxhash64("lines", "library_id"))).alias("r"))
    return best.select("id", "r.library_id", "r.lines").where("library_id is not null")


def _needed(docs: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """(library_id, needed): the least support of a repeated line of each library."""
    n = docs.groupBy("library_id").agg(F.count("*").alias("n"))
    return n.select("library_id", F.greatest(F.lit(min_documents), F.ceil(F.col("n") * F.lit(min_share) - F.lit(1e-9))).alias("needed"))


def repeated_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(library_id, line, support): lines in at least ``min_documents`` and ``min_share`` of a library's documents.

    Each document adds a line once. Counts are combined before the shuffle and keyed by library and line, so neither
    a large library nor a very frequent line fills one task.
    """
    lines = docs.select("library_id", F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("line"))
    support = lines.select("library_id", "line.h", "line.g").groupBy("library_id", "h", "g").agg(F.count("*").alias("support")).where(F.col("support") >= min_documents)
    out = support.join(_needed(docs, min_documents, min_share), "library_id").where("support >= needed")
    return out.select("library_id", F.struct("h", "g").alias("line"), "support")


def repeated_by_library(nodes: DataFrame) -> DataFrame:
    """(library_id, repeated): a library's repeated lines in one array. It holds fewer than 1/min_share times as many
    lines as an average document of the library has, however many documents there are."""
    return nodes.groupBy("library_id").agg(F.collect_set("line").alias("repeated"))


def repeated_edges(docs: DataFrame, nodes: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(library_id, a, b, support): pairs of repeated lines that follow each other, with nothing but short lines
    between, in enough documents of the library."""
    kept = docs.join(repeated_by_library(nodes), "library_id").select(
        "library_id", F.filter("lines", lambda x: F.coalesce(F.array_contains("repeated", x), F.lit(False))).alias("k")
    ).where(F.size("k") > 1)
    pairs = F.array_distinct(F.zip_with(F.slice("k", 1, F.size("k") - 1), F.slice("k", 2, F.size("k")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    edges = kept.select("library_id", F.explode(pairs).alias("e")).groupBy("library_id", "e.a", "e.b").agg(F.count("*").alias("support"))
    out = edges.where(F.col("support") >= min_documents).join(_needed(docs, min_documents, min_share), "library_id")
    return out.where("support >= needed").select("library_id", "a", "b", "support")


def boilerplate_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(library_id, line, support, block): blocks are connected components of edges, numbered by a hash of their
    smallest line; a line without edges is a block of its own."""
    key = lambda c: F.md5(F.concat_ws("|", "library_id", f"{c}.h", f"{c}.g"))
    found = connected_components(edges.select(key("a").alias("a"), key("b").alias("b")))
    out = nodes.withColumn("node", key("line")).join(found, "node", "left")
    return out.select("library_id", "line", "support", F.coalesce("component", "node").alias("block"))


def blocks_by_library(blocks: DataFrame) -> DataFrame:
    """(library_id, repeated, block_of): a library's boilerplate lines in one array, as bounded as
    :func:`repeated_by_library`, and the block of each."""
    own = blocks.groupBy("library_id").agg(F.collect_set(F.struct("line", "block")).alias("b"))
    return own.select("library_id", F.col("b.line").alias("repeated"), F.map_from_entries(F.transform("b", lambda x: F.struct(x["line"], x["block"]))).alias("block_of"))


def library_blocks(docs: DataFrame) -> DataFrame:
    """(library_id, line, support, block) of prepared documents, written once: what is found and removed comes from it."""
    nodes = materialize(repeated_lines(docs), "line-nodes")
    return materialize(boilerplate_blocks(nodes, repeated_edges(docs, nodes)), "line-blocks")


def block_occurrences(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, line_no, block): every place where a line of a block of its library stands, lines counted from 0."""
    hit = docs.join(blocks_by_library(blocks), "library_id").where(F.arrays_overlap("lines", "repeated"))
    at = hit.select("id", "repeated", "block_of", F.posexplode("lines").alias("line_no", "line"))
    return at.where("array_contains(repeated, line)").select("id", "line_no", F.col("block_of")[F.col("line")].alias("block"))


def prepared_documents(df: DataFrame, doc_id: str = "id", library: str = "library_id", content: str = "content", version: str | None = "indexed_at") -> DataFrame:
    """The documents' line keys, written once: support, edges and occurrences all read it."""
    return materialize(latest_documents(df, doc_id, library, content, version), "lines")


def remove_blocks(df: DataFrame, blocks: DataFrame, library: str = "library_id", content: str = "content") -> DataFrame:
    """Every row of ``df`` with the lines of its library's blocks taken out of ``content``, and their number as
    ``lines_removed``, which replaces a column of that name.

    Each row is matched by its own lines, so rows of one id with different contents lose only their own boilerplate.
    Null libraries, contents without such lines, null and empty ones come back as they are; a content of nothing else
    becomes empty. Texts aren't shuffled while a library's blocks are small enough to be broadcast; Spark checks that.
    """
    own = repeated_by_library(blocks).select(F.col("library_id").alias("_library"), F.col("repeated").alias("_gone"))
    out = df.drop("_library", "_gone", "_lines", "lines_removed").join(own, F.col(library) == F.col("_library"), "left")
    out = out.withColumn("_lines", F.zip_with(F.split(content, "\n"), line_keys(F.col(content)), lambda x, k: F.struct(x.alias("x"), F.coalesce(F.array_contains("_gone", k), F.lit(False)).alias("gone"))))
    kept = F.transform(F.filter("_lines", lambda s: ~s["gone"]), lambda s: s["x"])
    removed = F.coalesce(F.size("_lines") - F.size(kept), F.lit(0))
    out = out.withColumn("lines_removed", F.when(F.col("_gone").isNull() | F.col("_lines").isNull(), 0).otherwise(removed))
    return out.withColumn(content, F.when(F.col("lines_removed") == 0, F.col(content)).otherwise(F.array_join(kept, "\n"))).drop("_library", "_gone", "_lines")
