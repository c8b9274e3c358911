"""Encoding a corpus with a public byte-level BPE tokenizer (tiktoken over a local rank file).

Defined ids: an empty text gives an empty list, a null text gives null. Text that looks like a special
token is plain text, since no special tokens are registered. Texts of any length are encoded whole: long
ones are cut at safe boundaries first, between a character and white space that follows it, where the
pre-splitting pattern always ends a piece, so the ids are those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZER_DIR = os.environ.get("TARRAFA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the pre-splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many characters are cut into windows of about this size.
WINDOW = 65_536
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in encoding(path)._mergeable_ranks.items()}


def rank_file(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> str:
    return os.path.join(directory, f"{vocabulary}.tiktoken")


def safe_windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Consecutive pieces of ``text`` that are encoded alike apart and together."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(text: str, path: str) -> np.ndarray:
    enc = encoding(path)
    if len(text) <= WINDOW:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(w, disallowed_special=()) for w in safe_windows(text)])


def decode_ids(ids, path: str) -> str:
    """Ids back to text over raw bytes, so that pieces of one character meet before decoding."""
    table = token_bytes(path)
    return b"".join(table[int(i)] for i in ids).decode("utf-8", errors="replace")


def _encode_batches(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            ids, lengths = [], np.zeros(len(texts), dtype=np.int64)
            for i, t in enumerate(texts):
                if (s := t.as_py()) is not None and s:
                    e = encode_text(s, path)
                    lengths[i] = len(e)
                    if not counts_only:
                        ids.append(e)
            nulls = texts.is_null()
            if counts_only:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, mask=nulls.to_numpy(zero_copy_only=False))], names=["_key", "n_tokens"])
            else:
                values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, values, mask=nulls)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["_key", "ids"])

    return run


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of each row, ids as array<int>; no shuffle, one Arrow pass over the two columns."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("_key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(_encode_batches(path or rank_file(), False), schema)
    return out.withColumnRenamed("_key", key)


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens) of each row; null for a null text."""
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("n_tokens", T.LongType())])
    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(_encode_batches(path or rank_file(), True), schema)
    return out.withColumnRenamed("_key", key)


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text) of lists of ids; null for null. Ids outside the vocabulary raise an error."""
    at = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, at) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_key", "text"])

    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("text", T.StringType())])
    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(run, schema).withColumnRenamed("_key", key)
