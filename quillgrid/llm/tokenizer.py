"""Public tokenizers inside tasks: the vocabulary file is read once by the driver and broadcast (fixed size)."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of ASCII only, in the syntax of the standard library.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Vocabularies that split texts by that pattern; others are refused, as they would give wrong ids.
VOCABULARIES = ("byte_bpe_50k",)
#: Pieces that a task remembers before it starts afresh: bounds memory, never changes a result.
MEMO_PIECES = 300_000
#: Texts whose number of tokens a task remembers.
MEMO_TEXTS = 100_000

_loaded: dict[str, object] = {}


class Vocabulary:
    """A byte-level BPE vocabulary that travels to executors as a broadcast of its two published files.

    ``version`` is its name with a hash of both files, so counts made under other files of that name aren't reused.
    """

    def __init__(self, spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
        if name not in VOCABULARIES:
            raise ValueError(f"no splitting pattern is known for the vocabulary {name!r}; known: {', '.join(VOCABULARIES)}")
        with open(os.path.join(folder, name + ".json"), "rb") as f, open(os.path.join(folder, name + ".tiktoken"), "rb") as g:
            self.files = spark.sparkContext.broadcast((f.read(), g.read()))
        self.name = name
        self.version = name + ":" + hashlib.sha256(b"\0".join(self.files.value)).hexdigest()[:16]

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.files.value[1].splitlines())}

    def tokenizer(self):
        """The tokenizers library's own object; special tokens' strings are ordinary text to it."""
        if (key := "tokenizers:" + self.version) not in _loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
            from tokenizers import Tokenizer

            found = Tokenizer.from_str(self.files.value[0].decode())
            found.encode_special_tokens = True
            _loaded[key] = found
        return _loaded[key]

    def counter(self):
        """The same vocabulary in tiktoken, which is faster where only numbers of tokens are needed."""
        if (key := "tiktoken:" + self.version) not in _loaded:
            import tiktoken

            _loaded[key] = tiktoken.Encoding(self.name, pat_str=PATTERN, mergeable_ranks=self.ranks(), special_tokens={})
        return _loaded[key]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; an id that stands for no bytes (a special token) has none."""
        if (key := "bytes:" + self.version) not in _loaded:
            ranks = self.ranks()
            table = [b""] * (max(ranks.values()) + 1)
            for raw, rank in ranks.items():
                table[rank] = raw
            _loaded[key] = table
        return _loaded[key]


def encode_texts(vocabulary: Vocabulary, texts: list[str | None], memo: dict[str, list[int]]) -> list[list[int]]:
    """Token ids of each text; null and empty texts have none.

    A byte-level BPE never merges over the borders of its splitting pattern, so each text is split and the library
    encodes every distinct piece once; ``memo`` keeps the ids of pieces already met by the task.
    """
    import re

    import regex

    if "patterns" not in _loaded:
        _loaded["patterns"] = (re.compile(ASCII_PATTERN, re.A), regex.compile(PATTERN))
    ascii_only, general = _loaded["patterns"]
    pieces = [[] if not t else (ascii_only if t.isascii() else general).findall(t) for t in texts]
    if len(memo) > MEMO_PIECES:
        memo.clear()
    new = list({p for ps in pieces for p in ps if p not in memo})
    for p, e in zip(new, vocabulary.tokenizer().encode_batch_fast(new, add_special_tokens=False)):
        memo[p] = e.ids
    out = []
    for ps in pieces:
        ids: list[int] = []
        for p in ps:
            ids += memo[p]
        out.append(ids)
    return out


def encode_documents(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), slice_rows: int = 512) -> DataFrame:
    """(*keep, ids): the token ids of each row's whole text, without special tokens, over Arrow batches.

    A null and an empty text both give an empty list. Strings that look like special tokens are ordinary text. One row
    comes out for each row that goes in, repeated rows included; other columns of ``df`` are not read.
    """
    source = df.select(*keep, F.col(text).alias("_text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                ids = encode_texts(vocabulary, batch.column("_text").to_pylist(), memo)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [column], names=names + ["ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(run, f"{schema}, ids array<int>")


def token_offsets(width: np.ndarray, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the characters [start, end) that each token touches; ``width`` has the bytes of each id.

    Tokens are laid over the bytes of the text; bytes are mapped to characters by counting those that begin one. A
    token that holds only a part of a character touches that whole character, as do the tokens with its other parts.
    """
    raw = np.frombuffer(text.encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    size = width[ids]
    ends = np.cumsum(size)
    return char_of[ends - size], char_of[ends - 1] + 1


def offset_documents(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), slice_rows: int = 512) -> DataFrame:
    """(*keep, starts, ends): the characters [start, end) that each token of each row's whole text touches, by
    :func:`token_offsets`; null and empty texts give empty lists."""
    source = df.select(*keep, F.col(text).alias("_text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        width = np.array([len(x) for x in vocabulary.token_bytes()], np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(at, slice_rows)
                texts = batch.column("_text").to_pylist()
                found = [token_offsets(width, t or "", x) for t, x in zip(texts, encode_texts(vocabulary, texts, memo))]
                offsets = pa.array(np.cumsum([0] + [len(a) for a, _ in found]), pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]), pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + columns, names=names + ["starts", "ends"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(run, f"{schema}, starts array<int>, ends array<int>")


def covered_characters(offsets: DataFrame) -> DataFrame:
    """``offsets`` with ``n_chars`` in place of starts and ends: how many characters its tokens touch, each once.

    Tokens follow each other, so a token adds what lies beyond the end of the one before it.
    """
    before = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    fresh = F.zip_with(F.arrays_zip("starts", "ends"), F.slice(before, 1, F.size("ends")), lambda t, b: t["ends"] - F.greatest(t["starts"], b))
    return offsets.withColumn("n_chars", F.aggregate(fresh, F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(x, F.lit(0)))).drop("starts", "ends")


def decode_ids(table: list[bytes], ids: list[int]) -> str:
    """The text of a list of ids: bytes are joined before they are decoded, so characters split over tokens come whole.

    Bytes that form no character (a list cut inside one) become the replacement character.
    """
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def decode_documents(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, text): the reverse of :func:`encode_documents`; null and empty lists give an empty text."""
    source = df.select(*keep, F.col(ids).alias("_ids"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.token_bytes()
        for batch in batches:
            texts = [decode_ids(table, x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(texts, pa.string())], names=names + ["text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_ids")
    return source.mapInArrow(run, f"{schema}, text string")


def token_counts(df: DataFrame, vocabulary: Vocabulary, text: str, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, n_tokens): the number of tokens of each row's whole text; 0 for null and empty texts.

    A task encodes a text once, however many of its rows carry it, as long as it stays among the last MEMO_TEXTS
    distinct ones; texts are remembered by a 128-bit hash.
    """
    source = df.select(*keep, F.col(text).alias("_text"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.counter().encode_ordinary
        memo: dict[bytes, int] = {}

        def count(t: str) -> int:
            key = hashlib.blake2b(t.encode(), digest_size=16).digest()
            if key not in memo:
                if len(memo) >= MEMO_TEXTS:
                    memo.clear()
                memo[key] = len(encode(t))
            return memo[key]

        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(n, pa.int64())], names=names + ["n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(run, f"{schema}, n_tokens bigint")
