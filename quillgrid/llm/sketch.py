"""A count sketch over all rows: which keys of an inverted list may be long, in a table whose size doesn't depend on the data."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SKETCH_BITS = 20
_BLOCKS = 64


def slots_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The counter of each 64-bit key."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def count_sketch(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int = SKETCH_BITS) -> np.ndarray:
    """How often each counter's keys occur over all rows, above what an ordinary counter holds: 2^bits numbers of uint32.

    ``keys`` gives the 64-bit keys of a batch. Blocks of counters are summed by a two-level tree. The median counter is
    taken off all of them: in a table of very many keys every counter holds many rare ones, and what stands out above
    that are the frequent keys. A rare key in a frequent key's counter looks frequent, never the other way round by
    more than the spread of the counters.
    """
    blocks = min(_BLOCKS, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(slots_of(keys(batch).ravel(), bits), minlength=len(total))
        parts = total.reshape(blocks, -1)
        full = [i for i in range(blocks) if parts[i].any()]
        if full:
            group = int(total.sum()) % 64
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([group] * len(full), pa.int32()), pa.array([zlib.compress(parts[i].astype("<i8").tobytes(), 1) for i in full], pa.binary())], names=["block", "grp", "counts"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["counts"])
        return pd.DataFrame({"block": [key[0]], "grp": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "block int, grp int, counts binary"
    rows = df.mapInArrow(count, schema).groupBy("block", "grp").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).collect()
    out = np.zeros((blocks, (1 << bits) // blocks), np.int64)
    for r in rows:  # at most _BLOCKS rows
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    out = out.ravel()
    return np.clip(out - int(np.median(out)), 0, 2**32 - 1).astype(np.uint32)
