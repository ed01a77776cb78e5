"""Likeness of texts: the share of common members in their sets of three successive words.

The JVM brings a text to its words (upper-cased runs of letters and digits, one blank between them); numpy hashes
words and shingles of whole Arrow batches and draws a signature of minima, one for each coordinate. Shingles are
compared as 52-bit hashes, which only ever meet within one pair of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Coordinates that problem 5 compares, and all of a signature: the hash forest of problem 2 has 40 trees of 3 of their own.
COORDINATES, ALL_COORDINATES = 40, 120
#: Bits of each coordinate that travel with a posting: 21 coordinates fill one 64-bit number.
_PER_LONG, _BITS = 21, 3
_MASK = sum(1 << (_BITS * i) for i in range(_PER_LONG))
#: Texts, and bytes of text, that are hashed at a time; a longer text is hashed alone.
_SLICE, _SLICE_BYTES = 2048, 4 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_MULTIPLY = (_rng.integers(0, 2**31, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint64).astype(np.uint32)
_rng = np.random.Generator(np.random.PCG64(20240301))
_MORE = ALL_COORDINATES - COORDINATES
_MULTIPLY = np.concatenate([_MULTIPLY, (_rng.integers(0, 2**31, _MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)])
_ADD = np.concatenate([_ADD, _rng.integers(0, 2**32, _MORE, dtype=np.uint64).astype(np.uint32)])
_LOW52 = np.uint64((1 << 52) - 1)


def words(text: Column) -> Column:
    """Upper-cased runs of letters and digits with single blanks between them; empty where there is none."""
    return F.trim(F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]+", " "))


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def shingle_sets(texts: list[bytes]) -> np.ndarray:
    """The sorted distinct members (text number << 52 | 52-bit shingle) of up to 4,096 texts of words.

    A text of one or two words has one member that stands for exactly these words; a text without words has none.
    """
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    power, inverse = _powers(_BASE, len(raw)), _powers(_BASE_INVERSE, len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power)])
    end = np.flatnonzero(raw == 32)
    start = np.concatenate([np.zeros(1, np.int64), end[:-1] + 1])
    doc = np.searchsorted(np.cumsum(size + 1) - 1, start, "right")
    real = end > start
    start, end, doc = start[real], end[real], doc[real]
    w = (sums[end] - sums[start]) * inverse[start]
    w ^= w >> _u(29)
    w *= _u(0xBF58476D1CE4E5B9)
    w ^= w >> _u(32)
    n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    parts, owners = [], []
    if len(w) > 2:
        inside = doc[2:] == doc[:-2]
        parts.append(((w[:-2] * _u(0x9E3779B97F4A7C15) + w[1:-1]) * _u(0xC2B2AE3D27D4EB4F) + w[2:])[inside])
        owners.append(doc[:-2][inside])
    few = np.flatnonzero((n[doc] < 3) & np.concatenate([np.ones(1, bool), doc[1:] != doc[:-1]])) if len(w) else np.zeros(0, np.int64)
    if len(few):
        second = np.where(n[doc[few]] == 2, w[np.minimum(few + 1, len(w) - 1)], _u(0))
        parts.append(w[few] * _u(0xD6E8FEB86659FD93) + second + _u(1))
        owners.append(doc[few])
    if not parts:
        return np.zeros(0, np.uint64)
    s, owner = np.concatenate(parts), np.concatenate(owners).astype(np.uint64)
    s ^= s >> _u(31)
    s *= _u(0x94D049BB133111EB)
    found = np.sort((owner << _u(52)) | (s >> _u(12)))
    return found[np.concatenate([np.ones(1, bool), found[1:] != found[:-1]])] if len(found) else found


def signatures(members: np.ndarray, coordinates: int = ALL_COORDINATES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, set hashes [n, 2], sizes, signature [n, coordinates] of uint32) of the texts that have members."""
    owner = members >> _u(52)
    begin = np.flatnonzero(np.concatenate([np.ones(1, bool), owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    sig = np.empty((len(begin), coordinates), np.uint32)
    both = np.empty((len(begin), 2), np.uint64)
    if not len(begin):
        return owner[begin], both, begin, sig
    base = members & _LOW52
    x = ((base * _u(0xD6E8FEB86659FD93)) >> _u(32)).astype(np.uint32)
    for k in range(coordinates):
        v = x * _MULTIPLY[k] + _ADD[k]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        sig[:, k] = np.minimum.reduceat(v, begin)
    for i, m in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
        h = base * _u(m)
        h ^= h >> _u(30)
        h *= _u(0xBF58476D1CE4E5B9)
        h ^= h >> _u(27)
        both[:, i] = np.add.reduceat(h, begin)
    return owner[begin].astype(np.int64), both, np.diff(np.append(begin, len(members))), sig


def packed_bits(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of all coordinates in two 64-bit numbers, for counting possible agreements inside a join."""
    low = (sig & np.uint32((1 << _BITS) - 1)).astype(np.uint64)
    out = []
    for part in (low[:, :_PER_LONG], low[:, _PER_LONG:]):
        shift = np.arange(part.shape[1], dtype=np.uint64) * _u(_BITS)
        out.append(np.bitwise_or.reduce(part << shift, axis=1).astype(np.int64) if part.shape[1] else np.zeros(len(sig), np.int64))
    return out[0], out[1]


def possible_agreements(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """How many coordinates of two postings agree in their low bits: never fewer than those that agree in full."""
    def apart(x: str, y: str) -> str:
        z = f"({x} ^ {y})"
        return f"bit_count(({z} | shiftright({z}, 1) | shiftright({z}, 2)) & {_MASK}L)"

    return F.expr(f"{COORDINATES} - {apart(a[0], b[0])} - {apart(a[1], b[1])}")


def _slices(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Parts of a batch of bounded size with the bytes of the texts in some of its columns."""
    texts = [[t.encode() for t in batch.column(c).to_pylist()] for c in columns]
    size = [sum(map(len, row)) for row in zip(*texts)]
    start = held = 0
    for i, n in enumerate(size):
        if i > start and (held + n > _SLICE_BYTES or i - start == _SLICE):
            yield batch.slice(start, i - start), [t[start:i] for t in texts]
            start, held = i, 0
        held += n
    if start < len(size):
        yield batch.slice(start), [t[start:] for t in texts]


def with_signatures(df: DataFrame, text: str, keep: tuple[str, ...], coordinates: int = ALL_COORDINATES, short: bool = False, with_words: bool = False) -> DataFrame:
    """(*keep, h1, h2, n_members, sig): hash of the text's set (128 bits), its size, its signature as bytes: 32 bits of
    each of the first ``coordinates``, or 16 of them for :func:`short_matrix`. ``with_words`` adds the text's ``words``.

    Rows without any word (null, blank, punctuation) are left out; all others have one row each.
    """
    source = df.select(*keep, words(F.col(text)).alias("_words")).where("_words <> ''")
    names = list(keep)
    words_too = ["words"] * with_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, (texts,) in _slices(whole, ("_words",)):
                rows, both, n, sig = signatures(shingle_sets(texts), coordinates)
                picked = batch.take(pa.array(rows, pa.int64()))
                sig = shortened(sig).astype("<u2") if short else sig.astype("<u4")
                width = coordinates * sig.itemsize
                data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [picked.column(c) for c in names] + [pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64)), pa.array(n.astype(np.int32)), data] + [picked.column("_words")] * with_words,
                    names=names + ["h1", "h2", "n_members", "sig"] + words_too,
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_words")
    return source.mapInArrow(run, f"{schema}, h1 bigint, h2 bigint, n_members int, sig binary" + ", words string" * with_words)


def signature_matrix(column: pa.Array) -> np.ndarray:
    """The first coordinates of a column of signatures as an array [rows, COORDINATES]."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)[:, :COORDINATES]


def shortened(sig: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def short_matrix(column: pa.Array) -> np.ndarray:
    """16 bits of each coordinate of a column of signatures, kept whole or short, [rows, ALL_COORDINATES]."""
    data = b"".join(column.to_pylist())
    if len(data) == len(column) * ALL_COORDINATES * 2:
        return np.frombuffer(data, "<u2").reshape(-1, ALL_COORDINATES)
    return shortened(np.frombuffer(data, "<u4").reshape(-1, ALL_COORDINATES))


def exact_likeness(pairs: DataFrame, keep: tuple[str, ...], at_least: float) -> DataFrame:
    """(*keep, likeness) of those pairs of texts of words (``words_a``, ``words_b``) that are at least so alike."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _slices(whole, ("words_a", "words_b")):
                sets = [shingle_sets(t) for t in texts]
                n = [np.bincount((s >> _u(52)).astype(np.int64), minlength=batch.num_rows) for s in sets]
                merged = np.sort(np.concatenate(sets))
                common = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> _u(52)).astype(np.int64), minlength=batch.num_rows)
                either = n[0] + n[1] - common
                like = np.divide(common, either, out=np.zeros(batch.num_rows), where=either > 0)
                good = np.flatnonzero(like >= at_least - 1e-12)
                picked = batch.take(pa.array(good, pa.int64()))
                yield pa.RecordBatch.from_arrays([picked.column(c) for c in names] + [pa.array(like[good])], names=names + ["likeness"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in names)
    order = [f.name for f in pairs.schema if f.name in names]
    names = order
    return pairs.select(*order, "words_a", "words_b").mapInArrow(run, f"{schema}, likeness double")
