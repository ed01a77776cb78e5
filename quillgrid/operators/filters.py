"""Compiling filters given as data into predicates that reach the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

_RANGE = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


def _one(df: DataFrame, name: str, wanted: Any, list_mode: str) -> Column:
    c = F.col(name)
    is_array = isinstance(df.schema[name].dataType, T.ArrayType)
    if isinstance(wanted, dict):
        unknown = set(wanted) - set(_RANGE)
        if unknown:
            raise ValueError(f"unknown bounds {sorted(unknown)} for {name}")
        return reduce(lambda a, b: a & b, [_RANGE[k](c, v) for k, v in wanted.items()], F.lit(True))
    if isinstance(wanted, (list, tuple, set)):
        values = list(wanted)
        if not values:
            return F.lit(False) if list_mode == "any" else F.lit(True)
        if is_array:
            given = F.array(*[F.lit(v) for v in values])
            return F.arrays_overlap(c, given) if list_mode == "any" else F.size(F.array_except(given, c)) == 0
        return c.isin(values) if list_mode == "any" else reduce(lambda a, b: a & b, [c == v for v in values])
    return F.array_contains(c, wanted) if is_array else (c.isNull() if wanted is None else c == wanted)


def compile_filter(df: DataFrame, filters: dict[str, Any] | None, list_mode: str = "any") -> Column:
    """A predicate of all given filters: a scalar is equality (None is null), a dict of gt, gte, lt, lte a range, a list
    any of its values (with ``list_mode="all"`` every one of them). No filters keep every row; unknown columns raise.
    """
    if list_mode not in ("any", "all"):
        raise ValueError("list_mode is any or all")
    missing = [k for k in filters or {} if k not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return reduce(lambda a, b: a & b, [_one(df, k, v, list_mode) for k, v in (filters or {}).items()], F.lit(True))


def apply_filter(df: DataFrame, filters: dict[str, Any] | None, list_mode: str = "any") -> DataFrame:
    return df.where(compile_filter(df, filters, list_mode))
