"""Quality of documents by dimensions, and likeness of pairs of texts by weighted terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillgrid.functions import patterns as P, text as X
from quillgrid.operators.documents import parsed
from quillgrid.operators.rollups import weighted

# Sections that a whole document has, keys that a well-formed one has, and weights of the dimensions.
SECTIONS = ("installation", "getting_started", "api_reference", "examples", "documentation", "readme")
STANDARD = ("metadata", "content", "documentation")
WEIGHTS = {"completeness": 0.25, "structure": 0.20, "content": 0.25, "metadata": 0.15, "format": 0.15}


def _step(cond: Column, gain: float) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), gain).otherwise(0.0)


def _total(*parts: Column) -> Column:
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def quality_dimensions(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, completeness, structure, content, metadata, format, overall): 0 to 1 each, for non-null texts.

    Keys count for JSON objects; other texts have none, and their text alone is measured.
    """
    t = F.col(text)
    rows = df.where(t.isNotNull()).select(row_id, t.alias("_t"), parsed(F.when(F.ltrim(t).startswith("{"), t)).alias("_v"))
    rows = rows.withColumn("_k", F.coalesce(F.json_object_keys(F.when(F.col("_v").isNotNull(), F.expr("to_json(_v)"))), F.expr("cast(array() as array<string>)")))
    k, n, low = F.col("_k"), F.size("_k"), F.lower("_t")
    share = lambda cond: F.when(n > 0, F.size(F.filter(k, cond)) / n).otherwise(0.0)
    has = lambda name: F.exists(k, lambda x: F.lower(x).contains(name))
    examples, calls = X.code_examples(F.col("_t")), X.api_references(F.col("_t"))
    nested = F.col("_v").isNotNull() & F.expr("schema_of_variant(_v)").rlike(r"OBJECT<.*OBJECT<")
    found = reduce(lambda a, b: a + b, [_step(has(s), 1 / len(SECTIONS)) for s in SECTIONS])
    field = lambda name: F.coalesce(F.try_variant_get("_v", f"$.metadata.{name}", "string"), F.try_variant_get("_v", f"$.{name}", "string"))
    naming = F.greatest(share(lambda x: x.contains("_") & (x == F.lower(x))), share(lambda x: F.substring(x, 2, 1000).rlike("[A-Z]")))
    install, usage = F.instr(low, "install"), F.instr(low, "usage")
    scores = {
        "completeness": _total(found, _step(examples > 0, 0.1), _step((low.contains("api") & (F.length("_t") > 1000)) | (calls > 5), 0.1), _step(X.has_installation(F.col("_t")), 0.05)),
        "structure": _total(_step(F.col("_v").isNotNull(), 0.3), _step(nested, 0.2), F.when(n > 2, naming * 0.2).otherwise(0.0), _step((install > 0) & (usage > 0) & (install < usage), 0.1), _step(low.rlike("api|reference"), 0.1), _step(low.contains("example"), 0.1)),
        "content": _total(*[_step(F.length("_t") > m, g) for m, g in ((1000, 0.2), (5000, 0.1), (10_000, 0.1))], _step(examples > 0, 0.2), _step(examples > 5, 0.1), _step(calls > 0, 0.2), _step(calls > 10, 0.1), _step(reduce(lambda a, b: a | b, [low.rlike(p) for ps in P.LANGUAGE_WEIGHTS.values() for p in ps]), 0.1)),
        "metadata": _total(*[_step(F.length(field(f)) > 0, 0.2) for f in ("name", "version", "description")], F.lit(0.0)),
        "format": _total(_step(F.col("_v").isNotNull(), 0.5), F.when(n > 1, share(lambda x: x == F.lower(x)) * 0.2).otherwise(0.0), reduce(lambda a, b: a + b, [_step(F.array_contains(k, s), 0.1) for s in STANDARD])),
    }
    out = rows.select(row_id, *[c.alias(name) for name, c in scores.items()])
    return out.withColumn("overall", weighted({name: (F.col(name), w) for name, w in WEIGHTS.items()}))


def pair_similarity(a: Column, b: Column) -> Column:
    """Cosine of two texts' tf-idf vectors, with the two as the whole collection; 0 where either has no term."""
    words = lambda t: F.filter(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(*P.STOP_WORDS))
    return X.let(F.struct(words(a).alias("a"), words(b).alias("b")), lambda t: _cosine(t["a"], t["b"]))


def _cosine(wa: Column, wb: Column) -> Column:
    weight = lambda w: F.log(F.lit(3.0) / (1 + F.array_contains(wa, w).cast("int") + F.array_contains(wb, w).cast("int"))) + 1
    value = lambda own, w: F.size(F.filter(own, lambda x: x == w)) * weight(w)
    pairs = F.transform(F.array_union(wa, wb), lambda w: F.struct(value(wa, w).alias("x"), value(wb, w).alias("y")))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    add = lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"))
    end = lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / (F.sqrt(s["xx"]) * F.sqrt(s["yy"]))).otherwise(0.0)
    return F.aggregate(pairs, zero, add, end)
