"""Content hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def short_sha(text: Column, digits: int = 16) -> Column:
    """The first hex digits of SHA-256; null for null."""
    return F.substring(F.sha2(text, 256), 1, digits)


def entry_hash(*parts: Column) -> Column:
    """SHA-256 over the parts with bars between them, null as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def query_key(text: Column) -> Column:
    """MD5 of the trimmed, lower-cased query."""
    return F.md5(F.lower(F.trim(text)))


@F.pandas_udf(T.StringType())
def xxh64_hex(texts: pd.Series) -> pd.Series:
    """xxHash64 with seed 0 as 16 hex digits; Spark's own function has another seed."""
    import xxhash

    return texts.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t))
