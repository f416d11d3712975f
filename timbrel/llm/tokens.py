"""Problem 8: the whole corpus as token ids of a public byte-level tokenizer.

The ``tokenizers`` library does the encoding, over Arrow batches. A byte-level BPE
never merges across its pre-tokens, and a corpus has few distinct ones, so each
distinct pre-token is encoded by the library once per task and looked up afterwards;
the result is that of encoding whole texts (a test compares them over every
character of the basic plane). Texts with characters beyond that plane, on whose
classes two Unicode tables may differ, are encoded whole.

A vocabulary file with another way of cutting, or one that normalises, is used by the library on whole texts; as its
texts cannot be read back from bytes, offsets and decoding refuse it.

Defined cases: null and empty texts give an empty list; special tokens in a text are
ordinary text; a repeated row comes out as often as it goes in; an empty table gives
an empty result; no text is cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIR = "/opt/tokenizers"
#: A task forgets its pre-token table at this many entries; the result does not depend on it.
MAX_CACHE = 1_000_000
#: Fixed value: the pre-token pattern of the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def byte_chars() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies use for it.

    Printable Latin-1 bytes stand for themselves; the others get the code points
    from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def is_plain(spec: dict) -> bool:
    """Whether a vocabulary file stands for bytes as they are, cut by :data:`PATTERN`."""
    cut = spec.get("pre_tokenizer") or {}
    return not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of the vocabulary file."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    if not is_plain(spec):
        raise ValueError(f"{path} changes texts, so its ids do not stand for their bytes")
    table = byte_chars()
    out = [b""] * (max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", []))]) + 1)
    for token, i in spec["model"]["vocab"].items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    for x in spec.get("added_tokens", []):
        out[x["id"]] = x["content"].encode()
    return out


class Encoder:
    """Encodes texts with one vocabulary file; keeps the ids of pre-tokens seen."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        self.plain = is_plain(json.loads(Path(path).read_text(encoding="utf-8")))
        self.wide = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def pretokens(self, text: str) -> list[str] | None:
        """The pre-tokens, or None where the text must be encoded whole."""
        if not self.plain:
            return None
        if text.isascii():
            return _ASCII.findall(text)
        return self.wide.findall(text) if max(text) <= "￿" else None

    def __call__(self, texts: list[str]) -> list[list[int]]:
        parts = [self.pretokens(x) for x in texts]
        new = list(set(chain.from_iterable(p for p in parts if p)).difference(self.known))
        if len(self.known) + len(new) > MAX_CACHE:
            self.known = {}
            new = list(set(chain.from_iterable(p for p in parts if p)))
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            self.known.update(zip(some, (e.ids for e in self.tok.encode_batch(some, add_special_tokens=False))))
        get = self.known.__getitem__
        return [
            self.tok.encode(text, add_special_tokens=False).ids if p is None else list(chain.from_iterable(map(get, p)))
            for text, p in zip(texts, parts)
        ]


def _lists(lists: list) -> pa.Array:
    """An Arrow list array out of Python lists or NumPy arrays."""
    ends = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    if lists and isinstance(lists[0], np.ndarray):
        flat = np.concatenate(lists).astype(np.int32)
    else:
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> DataFrame:
    """``(id_col, ids ARRAY<INT>)`` of each row, without special tokens."""
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or Encoder(path)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(enc([x or "" for x in b.column(1).to_pylist()]))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def encode_with_offsets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> DataFrame:
    """``(id_col, ids, starts, ends)``: the code points ``[start, end)`` each token touches.

    A token that holds part of a character has that whole character as its range, so
    neighbouring ranges overlap where a character is split.
    """
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = None, None
        for b in batches:
            if enc is None:
                enc, sizes = Encoder(path), np.array([len(x) for x in token_bytes(path)], np.int64)
            texts = [x or "" for x in b.column(1).to_pylist()]
            ids = enc(texts)
            starts, ends = [], []
            for text, row in zip(texts, ids):
                raw = np.frombuffer(text.encode(), np.uint8)
                char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
                size = sizes[np.array(row, np.int64)]
                stop = np.cumsum(size)
                starts.append(char[stop - size].astype(np.int32))
                ends.append((char[stop - 1] + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), _lists(starts), _lists(ends)], names=[id_col, "ids", "starts", "ends"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, ints) for n in ("ids", "starts", "ends"))])
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = DEFAULT_DIR) -> DataFrame:
    """``(id_col, text)``: bytes of all ids joined before they are read as UTF-8.

    Characters split over tokens come back whole; bytes that form no character, which
    only a cut id list can hold, become replacement characters. An unknown id is an
    error; a null list is an empty text.
    """
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            table = table or token_bytes(path)
            texts = [b"".join(map(table.__getitem__, row or ())).decode("utf-8", "replace") for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return df.select(id_col, ids_col).mapInArrow(run, schema)
