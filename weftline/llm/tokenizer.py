"""Encoding of a corpus with a byte-level BPE vocabulary given as ranks.

A piece of text is merged with a segment tree over its byte positions: the
leaf of a position holds the rank of the pair that starts there, a node the
leftmost minimum below it. The root names the next merge; each merge changes
the leaves of the live neighbours only, in logarithmic time, so a piece of n
bytes takes n log n steps however long it is. Pieces repeat, so each worker
keeps the ids of pieces it has seen.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spread import spread

#: Where the vocabulary files of the public tokenizers are.
TOKENIZERS = "/opt/tokenizers"
#: How the vocabulary's own encoder splits text before merging (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as Unicode defines it; the regular expression modules count four control characters too.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ANY = regex.compile(PATTERN.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Pieces a worker remembers, and the longest it remembers.
_KEPT, _KEPT_LENGTH = 500_000, 200

_NONE = 1 << 62


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}


class Encoder(dict):
    """ids of pieces, computed when first asked for; ``encode`` takes whole texts."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank

    def __missing__(self, piece: str) -> list[int]:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= _KEPT_LENGTH:
            if len(self) >= _KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        ids = [self.byte[b] for b in data]
        pairs = self.pairs
        width = 1 << max(1, (n - 1).bit_length())
        # rank * width + position: the smallest is the leftmost pair of the lowest rank
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get((ids[i], ids[i + 1]))
            if rank is not None:
                tree[width + i] = rank * width + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            k = width + at
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least
                k >>= 1

        while tree[1] != _NONE:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            ids[at] = rank
            right = after[at] = after[gone]
            put(gone, _NONE)
            if right < n:
                before[right] = at
                new = pairs.get((rank, ids[right]))
                put(at, _NONE if new is None else new * width + at)
            else:
                put(at, _NONE)
            left = before[at]
            if left >= 0:
                new = pairs.get((ids[left], rank))
                put(left, _NONE if new is None else new * width + left)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def pieces(self, text: str) -> list[str]:
        return (_ASCII if text.isascii() else _ANY).findall(text)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []


_built: dict[int, Encoder] = {}


def encoder(lines: bytes) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    key = hash(lines)
    if key not in _built:
        _built.clear()
        _built[key] = Encoder(parse_ranks(lines))
    return _built[key]


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS):
    """The vocabulary file as a broadcast value (under 1 MB, whatever the data); read on the driver, so executors need no copy."""
    with open(os.path.join(tokenizers, f"{name}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row, without special tokens.

    Null and empty texts have no ids (an empty list). The strings of special
    tokens are ordinary text. White space and stray characters are encoded as
    they stand. Repeated rows and null keys are kept; other columns are not
    read. An empty table gives an empty result.
    """
    lines = vocabulary(documents.sparkSession, name, tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(lines.value)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(enc.__getitem__, enc.pieces(t))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    one = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")), documents)
    out = T.StructType([T.StructField("key", one.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return one.mapInArrow(run, out).select(F.col("key").alias(key), "ids")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, count: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` of every row with the number of its tokens, 0 for a null or empty text."""
    lines = vocabulary(documents.sparkSession, name, tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(lines.value)
        for batch in batches:
            n = [sum(map(len, map(enc.__getitem__, enc.pieces(t)))) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], [*batch.schema.names[1:], count])

    one = spread(documents.select(F.col(text).alias("__text"), *keep), documents)
    return one.mapInArrow(run, T.StructType([*one.schema.fields[1:], T.StructField(count, T.LongType())]))
