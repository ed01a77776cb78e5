"""Splitting documents into chunks: table functions over Arrow batches, and window finishing in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.functions import text as X
from quillgrid.plans.materialize import materialize

_CALL = re.compile(r"\n(?=(?:GET|POST|PUT|DELETE|PATCH)\s+/)")
_FENCE = re.compile(r"(```.*?```)", re.S)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"\S+\s*")
# Where a structured text may be cut.
_STRUCTURE = re.compile(r"\n(?=\d+\.\s)|\n(?=\*\s)|\n(?=##\s)|\n(?=\|)|\n\n(?=[A-Z])")


def fixed_chunks(df: DataFrame, doc_id: str, text: str, size: int = 200) -> DataFrame:
    """(doc_id, chunk_index, content): consecutive runs of ``size`` words, without overlap; JVM only.

    Null, empty and blank texts give no chunk.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), X.SPACE), lambda w: w != "")
    rows = df.select(F.col(doc_id).alias("doc_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))
    out = rows.select("doc_id", F.explode(starts).alias("chunk_index"), "w")
    return out.select("doc_id", "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * size + 1, F.lit(size)), " ").alias("content"))


def strided_chunks(df: DataFrame, doc_id: str, text: str, size: int = 200, overlap: int = 40) -> DataFrame:
    """(doc_id, chunk_index, content): windows of ``size`` words that begin ``size - overlap`` words apart; the last
    one is the first that reaches the end."""
    step = size - overlap
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), X.SPACE), lambda w: w != "")
    rows = df.select(F.col(doc_id).alias("doc_id"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    out = rows.select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"), "w")
    return out.select("doc_id", "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * step + 1, F.lit(size)), " ").alias("content"))


def window_chunks(words: list[str], size: int, overlap: int, boundary: Callable[[str], bool], least: float) -> list[str]:
    """Windows over words that end at the last boundary beyond the share ``least`` of them, with ``overlap`` words
    carried over; always moves on, and ends with the window that reaches the end."""
    out, at = [], 0
    while at < len(words):
        end = min(at + size, len(words))
        if end < len(words):
            end = next((e for e in range(end, at + max(1, int(size * least)), -1) if boundary(words[e - 1])), end)
        out.append("".join(words[at:end]).strip())
        if end == len(words):
            break
        at = max(end - overlap, at + 1)
    return [c for c in out if c]


def narrative(text: str, size: int = 200, overlap: int = 40) -> list[str]:
    return window_chunks(_WORD.findall(text), size, overlap, lambda w: w.rstrip().endswith((".", "!", "?", "。")), 0.6)


def code_aware(text: str, size: int = 200, overlap: int = 20) -> list[str]:
    return window_chunks(_WORD.findall(text), size, overlap, lambda w: "\n" in w, 0.5)


def api_sections(text: str, size: int = 200) -> list[str]:
    """A chunk for each request line and what follows; longer ones are split by words."""
    out = []
    for part in _CALL.split(text):
        words = _WORD.findall(part)
        out += ["".join(words[i : i + size]).strip() for i in range(0, len(words), size)]
    return [c for c in out if c]


def _packed(parts: list[str], size: int, joint: str) -> list[str]:
    out: list[str] = []
    held, n = [], 0
    for p in parts:
        k = len(p.split())
        if held and n + k > size:
            out.append(joint.join(held))
            held, n = [], 0
        held.append(p)
        n += k
    return out + ([joint.join(held)] if held else [])


def mixed(text: str, size: int = 200) -> list[str]:
    """Fenced code kept whole, prose between it, packed up to the size; a part over it is a chunk of its own."""
    return _packed([p.strip() for p in _FENCE.split(text) if p.strip()], size, "\n\n")


def sentences(text: str, size: int = 200, overlap: int = 1) -> list[str]:
    """Sentences packed up to the size; a chunk begins with the last ``overlap`` sentences of the one before it, where
    these leave room for a new one."""
    out, held = [], []
    for s in (s.strip() for s in _SENTENCE.split(text)):
        if s and held and sum(len(x.split()) for x in held) + len(s.split()) > size:
            out.append(" ".join(held))
            held = held[-overlap:] if overlap and len(held) > overlap else []
            held = held if sum(len(x.split()) for x in held) + len(s.split()) <= size else []
        held += [s] if s else []
    return out + ([" ".join(held)] if held else [])


def structured(text: str, size: int = 200) -> list[str]:
    """Cut before numbered and bulleted items, second-level headers, table rows and paragraphs, packed up to the size;
    a text without any of them is cut like prose."""
    parts = [p for p in _STRUCTURE.split(text) if p.strip()]
    return _packed([p.strip("\n") for p in parts], size, "\n") if len(parts) > 1 else narrative(text, size)


STRATEGIES: dict[str, Callable[[str], list[str]]] = {"narrative": narrative, "code_aware": code_aware, "api": api_sections, "mixed": mixed, "sentences": sentences, "structured": structured}


def strategy(text: Column) -> Column:
    """mixed for fenced code among prose, code_aware for code, api for request lines, else narrative."""
    fence, prose = text.contains("```"), text.rlike(r"[.!?]\s+[A-Z]")
    code = text.rlike(r"(^|\n)[ \t]*(def|class|function|import|from|const|let|var)\s")
    api = text.rlike(r"(^|\n)(GET|POST|PUT|DELETE|PATCH)\s+/")
    return F.when(fence & prose, "mixed").when(api, "api").when(fence | code, "code_aware").otherwise("narrative")


def chunk_documents(df: DataFrame, doc_id: str, text: str, chosen: Column | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, strategy, chunk_index, total_chunks, chunk_id, content) by the strategy of each document.

    Documents are split where they are; numbering is done by position inside the splitter, so no shuffle is needed.
    Null and blank texts give no chunk. ``most`` keeps the first chunks of each document only where it is given.
    """
    rows = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), (strategy(F.col(text)) if chosen is None else chosen).alias("strategy"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t, s in zip(pdf["doc_id"], pdf["_text"], pdf["strategy"]):
                parts = STRATEGIES[s](t)[:most]
                out += [(i, s, n, len(parts), f"{i}_{n:03d}", c) for n, c in enumerate(parts)]
            yield pd.DataFrame(out, columns=["doc_id", "strategy", "chunk_index", "total_chunks", "chunk_id", "content"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, strategy string, chunk_index int, total_chunks int, chunk_id string, content string")


def with_neighbours(chunks: DataFrame, doc_id: str, position: str, chunk_id: str, length: Column) -> DataFrame:
    """Append previous_id, next_id, total and relative_size (length by the document's length; 0 where that is 0).

    Rows are range-partitioned by document and position, so a document of a third of all rows spreads over many tasks;
    neighbours across a border come from a table of each partition's first and last row.
    """
    ordered = materialize(chunks.withColumn("_len", length).repartitionByRange(doc_id, position).withColumn("_p", F.spark_partition_id()), "ordered")
    place = F.struct(F.col(doc_id).alias("d"), F.col(position).alias("o"), F.col(chunk_id).alias("c"))
    ends = ordered.groupBy("_p").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    by_part = Window.orderBy("_p")  # one row for each partition
    borders = ends.select("_p", F.lag("hi").over(by_part).alias("_before"), F.lead("lo").over(by_part).alias("_after"))
    inside = Window.partitionBy("_p", doc_id).orderBy(position)
    totals = ordered.groupBy(F.col(doc_id).alias("_d")).agg(F.count("*").alias("total"), F.sum("_len").alias("_sum"))
    near = ordered.withColumns({"previous_id": F.lag(chunk_id).over(inside), "next_id": F.lead(chunk_id).over(inside)}).join(F.broadcast(borders), "_p")
    first, last = (F.row_number().over(inside) == 1), (F.lead(F.lit(1)).over(inside).isNull())
    near = near.withColumns({
        "_previous": F.when(F.col("_before.d").eqNullSafe(F.col(doc_id)), F.col("_before.c")),
        "_next": F.when(F.col("_after.d").eqNullSafe(F.col(doc_id)), F.col("_after.c")),
        "_first": first, "_last": last,
    })
    joined = near.join(totals, F.col(doc_id).eqNullSafe(F.col("_d")))
    return joined.select(
        *chunks.columns,
        F.when(F.col("_first"), F.col("_previous")).otherwise(F.col("previous_id")).alias("previous_id"),
        F.when(F.col("_last"), F.col("_next")).otherwise(F.col("next_id")).alias("next_id"),
        "total",
        F.when(F.col("_sum") > 0, F.col("_len") / F.col("_sum")).otherwise(0.0).alias("relative_size"),
    )


def with_analysis(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Chunks with the hash of their content, their words and characters, what they hold and how whole they are."""
    c = F.col(content)
    flags = {k: X.feature(c, k) for k in ("has_code_examples", "has_api_references", "has_installation_instructions")}
    return chunks.select("*", F.sha2(c, 256).alias("content_hash"), X.word_count(c).alias("words"), F.length(c).alias("characters"), *[v.alias(k) for k, v in flags.items()], X.chunk_completeness(c, F.col("strategy")).alias("completeness"))
