"""Encoding of whole texts with a byte-level BPE vocabulary (problem 6).

The vocabulary is a local rank file; its folder is a parameter and the file is read once in each Python worker. Documents
pass through Arrow: one output array of ids for a slice of documents is built at a time, so a worker holds the ids of a
few megabytes of text whatever the size of a partition. There is no shuffle.

A text beyond ``LONG`` characters is cut where the pre-tokenizer has a token border whatever stands around it, and its parts are
encoded one after another; so one very long text costs no more for a character than a short one. Borders are

* between a character that is no white space and a white-space one: no alternative of the pattern holds white space after
  another character, and the look-ahead inside ``\\s+(?!\\S)`` only looks to the right of white space;
* between a letter and a digit (either order): an alternative that holds the one never goes on with the other.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary files are installed; every operator takes the folder as a parameter.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters from which a text is cut, and of one part at least.
LONG = 32_768

#: Bytes of text whose ids are held at once.
SLICE = 4_000_000

#: White space as the tokenizer's regex engine has it; Python's ``\s`` also holds four control characters.
_SPACE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_BORDER = regex.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})")


@lru_cache(maxsize=4)
def encoding(name: str, folder: str):
    """The tiktoken encoding of the rank file ``name`` in ``folder``; without special tokens."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` in order, cut at safe borders after ``long`` characters or more."""
    start = 0
    while len(text) - start > long:
        border = _BORDER.search(text, start + long)
        if border is None:
            break
        yield text[start : border.start()]
        start = border.start()
    yield text[start:]


def encode(text: str | None, name: str = "byte_bpe_50k", folder: str = VOCABULARIES, long: int = LONG) -> np.ndarray:
    """The ids of ``text`` as int32; no ids for null and for empty text."""
    if not text:
        return np.empty(0, np.int32)
    encoder = encoding(name, folder)
    if len(text) <= long:
        return np.array(encoder.encode_ordinary(text), np.int32)
    return np.concatenate([np.array(encoder.encode_ordinary(part), np.int32) for part in parts(text, long)])


def decode(ids, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> str:
    """The text of ``ids``: the raw bytes of all tokens are joined first, as a token may end inside a character."""
    return encoding(name, folder).decode_bytes(np.asarray(ids, np.int32).tolist()).decode("utf-8")


def _slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    sizes = np.diff(np.frombuffer(texts.cast(pa.large_string()).buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield start, k
            start, held = k, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def _single(df: DataFrame, column: str) -> None:
    if df.columns.count(column) != 1:
        raise ValueError(f"the table must have one column {column!r}, it has {df.columns}")


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """Each row of ``df`` as (key, ids), ids being an array of integers without special tokens.

    An empty and a null text give an empty list, never null. A null or repeated key is kept: rows correspond one to one.
    Other columns are not carried along, so their names cannot clash. An empty table gives an empty one.
    """
    _single(df, key), _single(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in _slices(texts):
                found = [encode(x.as_py(), name, folder) for x in texts.slice(a, b - a)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), True), True)])
    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """Each row of ``df`` as (key, n_tokens); 0 for empty and for null text."""
    _single(df, key), _single(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(encode(x.as_py(), name, folder)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType(), True)])
    return df.select(key, text).mapInArrow(run, schema)


def decode_texts(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """Each row of ``df`` as (key, text), the inverse of ``encode_texts``; a null list gives null text."""
    _single(df, key), _single(df, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends, held = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [decode(flat[a:b], name, folder) if valid else None for a, b, valid in zip(ends[:-1], ends[1:], held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType(), True)])
    return df.select(key, ids).mapInArrow(run, schema)
