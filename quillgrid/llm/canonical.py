"""Duplicates hidden by formatting differences (problem 1).

Titles and contents are brought to a canonical form, hashed to 128 bits and grouped with map-side combining. A second,
independent hash of the same form travels along; where it differs inside a group the 128-bit key has collided and the
group is split by it.

A content has two canonical forms. The flat one keeps its letters and digits in the order in which they stand. The
ordered one exists for blocks of labelled fields and for JSON objects and sorts their fields. Two entries are the
same if they agree in either form; groups are closed over both.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillgrid.operators.graph import connected_components
from quillgrid.plans.materialize import materialize

#: The labels of a block of labelled fields.
LABELS = ("TITLE", "DESCRIPTION", "SOURCE", "LANGUAGE", "CODE")
FIELD_START = r"(?im)^(?=[\t\p{Zs}]*(?:" + "|".join(LABELS) + r")[\t\p{Zs}]*:)"
NOT_ALNUM = r"[^\p{L}\p{N}]+"
SEPARATOR = "\x01"

_JUNK = re.compile(r"[\W_]+")


def squash(text: Column) -> Column:
    """Upper-cased letters and digits only. Upper case folds more pairs than lower case does (ss and sharp s)."""
    return F.regexp_replace(F.upper(text), NOT_ALNUM, "")


def is_blank(text: Column) -> Column:
    """True for null and for texts of nothing but white space, no-break spaces included."""
    return F.coalesce(~text.rlike(r"[^\s\p{Z}]"), F.lit(True))


class _Object(list):
    """The pairs of a JSON object, which may repeat a key."""


def _ordered(value: object) -> str:
    if isinstance(value, _Object):
        return "{" + SEPARATOR.join(sorted(_ordered(k) + ":" + _ordered(v) for k, v in value)) + "}"
    if isinstance(value, list):
        return "[" + SEPARATOR.join(_ordered(v) for v in value) + "]"
    text = value if isinstance(value, str) else json.dumps(value)
    return _JUNK.sub("", text.upper())


def ordered_json(text: str | None) -> str | None:
    """A JSON object with squashed scalars and with keys sorted at every level; None for anything else.

    Numbers keep the digits they are written with. Repeated keys are all kept.
    """
    if text is None:
        return None
    try:
        value = json.loads(text, object_pairs_hook=_Object, parse_int=str, parse_float=str, parse_constant=str)
        return _ordered(value) if isinstance(value, _Object) else None
    except RecursionError:
        return _ordered_deep(text)
    except ValueError:
        return None


#: One mark, string or bare word of a JSON text.
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^\s{}\[\],:"]+))')


def _ordered_deep(text: str) -> str | None:
    """:func:`ordered_json` for objects nested too deeply for the parser: open objects and arrays are kept on a list."""
    open_ones: list[tuple[bool, list[str]]] = []  # (object?, members so far); a member of an object waits as its key
    key: list[str | None] = []
    at, expect, done = 0, "value", None
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        found = _TOKEN.match(text, at)
        if not found or done is not None:
            return None
        at, (mark, string, word) = found.end(), found.groups()
        closed = None
        if mark in ("{", "[") and expect in ("value", "first"):
            open_ones.append((mark == "{", []))
            key.append(None)
            expect = "first key" if mark == "{" else "first"
        elif mark in ("}", "]") and open_ones and expect in ("next", "first key" if mark == "}" else "first") and open_ones[-1][0] == (mark == "}"):
            is_object, members = open_ones.pop()
            key.pop()
            closed = "{" + SEPARATOR.join(sorted(members)) + "}" if is_object else "[" + SEPARATOR.join(members) + "]"
        elif mark == "," and expect == "next":
            expect = "key" if open_ones[-1][0] else "value"
        elif mark == ":" and expect == "colon":
            expect = "value"
        elif string and expect in ("key", "first key"):
            key[-1], expect = _JUNK.sub("", json.loads(string).upper()), "colon"
        elif (string or word) and expect in ("value", "first"):
            try:
                value = json.loads(string or word, parse_int=str, parse_float=str, parse_constant=str)
            except ValueError:
                return None
            closed = _JUNK.sub("", (value if isinstance(value, str) else json.dumps(value)).upper())
        else:
            return None
        if closed is not None:
            if not open_ones:
                done = closed
            else:
                open_ones[-1][1].append(key[-1] + ":" + closed if open_ones[-1][0] else closed)
                expect = "next"
    return done if done is not None and done.startswith("{") else None


@F.pandas_udf(T.StringType())
def _ordered_json_udf(texts: pd.Series) -> pd.Series:
    return texts.map(ordered_json, na_action="ignore").astype(object).where(lambda s: s.notna(), None)


def with_canonical_keys(df: DataFrame, title: str, content: str) -> DataFrame:
    """Append ``flat`` and ``ordered`` (128-bit keys, hex), ``flat_check`` and ``ordered_check`` (64 bits).

    All are null where title or content is null or blank. ``ordered`` equals ``flat`` where the content has no fields
    to sort. Every other column passes through; new names that clash are overwritten.
    """
    body, real = F.col(content), ~is_blank(F.col(title)) & ~is_blank(F.col(content))
    head = squash(F.col(title))
    fields = F.split(body, FIELD_START)
    labelled = F.array_join(F.array_sort(F.filter(F.transform(fields, squash), lambda x: x != "")), SEPARATOR)
    json_like = F.when(real & body.rlike(r"^[\s\p{Z}]*\{"), F.trim(F.regexp_replace(body, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    flat = F.concat_ws("\x02", head, squash(body))
    ordered = F.concat_ws("\x03", head, F.col("_json"))
    out = df.withColumn("_json", _ordered_json_udf(json_like)).withColumn("_flat", F.when(real, flat))
    out = out.withColumn(
        "_ordered",
        F.when(real & F.col("_json").isNotNull(), ordered).when(real & body.rlike(FIELD_START), F.concat_ws("\x04", head, labelled)).otherwise(F.col("_flat")),
    )
    return out.withColumns(
        {"flat": F.md5("_flat"), "ordered": F.md5("_ordered"), "flat_check": F.xxhash64("_flat"), "ordered_check": F.xxhash64("_ordered")}
    ).withColumns({k: F.when(real, F.col(k)) for k in ("flat_check", "ordered_check")}).drop("_json", "_flat", "_ordered")


def formatting_groups(df: DataFrame, entry_id: str = "entry_id", title: str = "title", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Group records that differ only in how they are written: one row (id, group_key, *keep) for each record.

    Records with a null id, or with null or blank title or content, are no case and have no row. A repeated id counts
    as one record when its copies agree. The empty table gives an empty result.
    """
    keyed = with_canonical_keys(df.select(entry_id, title, content, *keep), title, content)
    rows = keyed.where(F.col(entry_id).isNotNull() & F.col("flat").isNotNull())
    rows = rows.select(
        F.col(entry_id).alias("id"),
        F.concat("flat", F.hex("flat_check")).alias("flat"),
        F.concat("ordered", F.hex("ordered_check")).alias("ordered"),
        *keep,
    )
    return unify_keys(materialize(rows, "canonical"))


def unify_keys(rows: DataFrame) -> DataFrame:
    """Replace ``flat`` and ``ordered`` by one ``group_key``, closing groups over both.

    A flat form links to the smallest ordered form met with it. Where one flat form has several ordered ones, these
    ordered forms are joined by connected components; there are few such forms, and no row but theirs is moved.
    """
    forms = rows.select("flat", "ordered").distinct()
    links = forms.groupBy("flat").agg(F.min("ordered").alias("a"), F.max("ordered").alias("b")).where("a <> b").select("flat", "a")
    edges = links.join(forms, "flat").select("a", F.col("ordered").alias("b")).where("a <> b")
    renamed = connected_components(edges).select(F.col("node").alias("ordered"), "component")
    out = rows.join(renamed, "ordered", "left")
    return out.select("id", F.coalesce("component", "ordered").alias("group_key"), *[c for c in rows.columns if c not in ("id", "flat", "ordered")])


def copy_counts(groups: DataFrame) -> DataFrame:
    """(group_key, first_id, copies) for each group: the smallest id and the number of distinct ids.

    Counts and minima are combined before the shuffle, so a group of any size costs one row per task.
    """
    return groups.select("group_key", "id").distinct().groupBy("group_key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def copies_found(groups: DataFrame) -> DataFrame:
    """(first_id, copy_id) for each member but the first of every group of two or more.

    Only minima are aggregated; members are joined back to them, where the skew join splits a large group.
    """
    first = groups.groupBy("group_key").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id <> last_id")
    out = groups.join(first.select("group_key", "first_id"), "group_key").where("id <> first_id")
    return out.select("first_id", F.col("id").alias("copy_id")).distinct()
