"""JSON documentation dumps and labelled blocks as tables: schema detection, sections, entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillgrid.functions import text as X
from quillgrid.plans.materialize import materialize

# Keys that tell the shape of a document, and keys that hold no content.
TOOL_KEYS = ("contexts", "library_info", "documentation_sections", "total_tokens")
STANDARD_KEYS = ("name", "version", "description", "installation", "api_reference")
COMMON_KEYS = ("content", "documentation", "text", "body", "readme", "docs", "sections", "title")
METADATA_KEYS = ("name", "version", "author", "license", "url", "homepage", "repository", "metadata", "id", "created_at", "updated_at")
# Labels of an entry's fields.
FIELDS = ("TITLE", "DESCRIPTION", "SOURCE", "LANGUAGE", "CODE")


def parsed(text: Column) -> Column:
    """A JSON text as VARIANT; where it doesn't parse, trailing commas are dropped, then quotes inside strings (those next to
    no bracket, colon or comma) are escaped; null for what doesn't parse even so."""
    no_commas = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    quoted = F.regexp_replace(no_commas, r'(?<![\[{:,]\s{0,9})(?<!^)(?<!\\)"(?!\s*([\]}:,]|$))', r'\\"')
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(no_commas), F.try_parse_json(quoted))


def document_shape(text: Column) -> Column:
    """tool_output, standard_library, generic_documentation, unknown (other objects), raw_text (anything else)."""
    keys = F.json_object_keys(F.when(text.rlike(r"^\s*\{"), text))
    shared = lambda names: F.size(F.array_intersect(keys, F.array(*[F.lit(n) for n in names])))
    return (
        F.when(keys.isNull(), "raw_text")
        .when(shared(TOOL_KEYS) >= 2, "tool_output")
        .when(shared(STANDARD_KEYS) >= 3, "standard_library")
        .when(shared(COMMON_KEYS) >= 1, "generic_documentation")
        .otherwise("unknown")
    )


def _explode(df: DataFrame, variant: str, view: str) -> DataFrame:
    """One row for each member of an object or array: pos, key, value."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"SELECT t.*, e.pos, e.key, e.value FROM {view} t, LATERAL variant_explode({variant}) e")


def sections(df: DataFrame, doc_id: str, text: str, least: int = 1) -> DataFrame:
    """(doc_id, name, level, content): every string of a JSON document at any depth with its path.

    Members of objects are named a.b, those of arrays a[i]; names of metadata are left out at the top level; blank
    strings and those under ``least`` characters are dropped. Documents that aren't JSON objects or arrays have one
    section named "content" with their text; null texts have none.
    """
    rows = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), parsed(F.when(F.col(text).rlike(r"^\s*[\[{]"), F.col(text))).alias("_v"))
    plain = rows.where("_v is null").select("doc_id", F.lit("content").alias("name"), F.lit(0).alias("level"), F.col("_text").alias("content"))
    level = rows.where("_v is not null").select("doc_id", F.lit("").alias("name"), F.col("_v").alias("v"))
    out, depth = plain, 0
    while depth == 0 or not level.isEmpty():  # one round for each level that any document has
        members = _explode(level, "t.v", f"quillgrid_sections_{depth}")
        name = F.when(F.col("key").isNull(), F.format_string("%s[%d]", "name", "pos")).when(F.col("name") == "", F.col("key")).otherwise(F.concat_ws(".", "name", "key"))
        members = members.select("doc_id", name.alias("name"), F.col("value").alias("v"), F.expr("schema_of_variant(value)").alias("kind"))
        if depth == 0:
            members = members.where(~F.lower("name").isin(*METADATA_KEYS))
        out = out.union(members.where("kind = 'STRING'").select("doc_id", "name", F.lit(depth), F.expr("variant_get(v, '$', 'string')")))
        level = materialize(members.where("kind like 'OBJECT%' or kind like 'ARRAY%'").select("doc_id", "name", F.expr("to_json(v)").alias("j")), "members")
        level, depth = level.select("doc_id", "name", F.parse_json("j").alias("v")), depth + 1
    return out.where((F.length(F.trim("content")) >= least) & (F.trim("content") != ""))


def section_facts(found: DataFrame) -> DataFrame:
    """Sections with id, type, hierarchy level, words and programming language."""
    c = F.col("content")
    return found.select("*", F.concat(F.lit("section_"), F.regexp_replace("name", r"[.\[\]]", "_")).alias("section_id"), X.section_type(c).alias("section_type"), X.hierarchy_level(F.col("name"), c).alias("hierarchy"), X.word_count(c).alias("words"), X.code_language(c).alias("code_language"))


def field(text: Column, label: str) -> Column:
    """The value after a label at the start of a line, up to the next label; null without one."""
    others = "|".join(FIELDS)
    found = F.regexp_extract(text, rf"(?is)(?:^|\n){label}:[ \t]*(.*?)(?=\n(?:{others}):|\z)", 1)
    clean = F.btrim(found, F.lit(" \t\r\n"))
    return F.when(clean != "", clean)


def entry_fields(df: DataFrame, entry_id: str, content: str) -> DataFrame:
    """(entry_id, title, description, source, language, code) of blocks of labelled fields; a field that a block doesn't
    have is null, and a text without a label has no row."""
    c = F.col(content)
    rows = df.where(c.rlike(r"(?i)(^|\n)(" + "|".join(FIELDS) + "):"))
    got = [field(c, f).alias(f.lower()) for f in FIELDS]
    return rows.select(F.col(entry_id).alias("entry_id"), *got).withColumn("language", F.lower("language"))


def split_entries(df: DataFrame, doc_id: str, text: str, least: int = 20) -> DataFrame:
    """(doc_id, section, entry_no, entry): documents cut at headers between rows of = and at lines of dashes.

    A section ends at the next header; text before the first one is in section "". Entries under ``least`` characters
    are dropped.
    """
    marked = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n={20,}\s*\n?(?=[^\n=]+\n?\s*={20,})")
    parts = df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(marked).alias("_no", "_part"))
    head = F.regexp_extract("_part", r"^([^\n=]+?)\s*\n?\s*={20,}", 1)
    body = F.regexp_replace("_part", r"^[^\n=]+?\s*\n?\s*={20,}", "")
    rows = parts.select("doc_id", "_no", F.when(F.col("_no") > 0, F.trim(head)).otherwise("").alias("section"), body.alias("_body"))
    cut = rows.select("doc_id", "_no", "section", F.posexplode(F.split("_body", r"(?m)^-{30,}$")).alias("_i", "_entry")).withColumn("entry", F.trim(F.regexp_replace("_entry", r"^\s+|\s+$", "")))
    kept = cut.where(F.length("entry") >= least)
    return kept.select("doc_id", "section", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_no", "_i")) - 1).alias("entry_no"), "entry")


def json_members(df: DataFrame, row_id: str, text: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """(row_id, name...): values at JSON paths, each with a Spark type; null where the path or the type doesn't fit."""
    v = F.try_parse_json(F.col(text))
    return df.select(row_id, v.alias("_v")).select(row_id, *[F.try_variant_get("_v", path, kind).alias(name) for name, (path, kind) in paths.items()])


def key_metrics(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, keys, nested, snake, camel, populated) of texts that are JSON objects: how many keys they have, of objects,
    in snake and camel case, and of strings of more than 10 characters."""
    rows = df.where(F.ltrim(text).startswith("{")).select(row_id, parsed(F.col(text)).alias("_v")).where("_v is not null")
    each = _explode(rows, "t._v", "quillgrid_key_metrics").select(row_id, "key", F.expr("schema_of_variant(value)").alias("kind"), F.expr("try_variant_get(value, '$', 'string')").alias("s"))
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    key = F.col("key")
    return each.groupBy(row_id).agg(
        F.count("*").alias("keys"),
        count(F.col("kind").startswith("OBJECT")).alias("nested"),
        count(key.contains("_") & (key == F.lower(key))).alias("snake"),
        count(F.substring(key, 2, 1000).rlike("[A-Z]")).alias("camel"),
        count((F.col("kind") == "STRING") & (F.length(F.trim("s")) > 10)).alias("populated"),
    )


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps in one; of a key that both have the right one's value is taken. Null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def exploded_list(df: DataFrame, keep: list[str], text: str, schema: str) -> DataFrame:
    """One row for each member of a JSON list with the members' fields; texts that are no list give no row."""
    return df.select(*keep, F.explode(F.from_json(F.col(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>")).alias("_e")).select(*keep, "_e.*")


def requests(chunks: DataFrame, content: str, preview: int = 200, quality: float = 0.5) -> DataFrame:
    """Chunks (id, library_id, version, programming_language, token_count, trust_score, content) as what is sent to be
    embedded and stored: hash and kind of the text, a preview, and defaults for what is missing."""
    c = F.col(content)
    return chunks.select(
        "id", "library_id", "version",
        F.coalesce("programming_language", F.lit("")).alias("programming_language"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.coalesce(F.col("trust_score") / 10, F.lit(quality)).alias("quality"),
        F.substring(c, 1, preview).alias("preview"),
        F.md5(c).alias("content_hash"),
        F.lit("document").alias("input_type"),
    )
