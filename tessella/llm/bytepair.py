"""Byte-level BPE by a monoid over halves of a text, and decoding up the same tree.

An element is a string of bytes with its token ids. Two neighbours join by encoding anew only a window
around their border:

* Between texts, a place between a non-space and a following white-space character always ends a match of the
  splitting pattern, since no alternative of it runs from a non-space into white space, and none looks
  behind. Matches left of the last such place in the left half, and right of the first in the right
  half, are those of the whole; only what lies between is split and encoded anew.
* Within one long match, the window takes tokens from both sides and grows until its first and last
  token come out as they were. Then every adjacent pair of tokens is one that stood in a valid
  encoding, which for merges by rank makes the whole sequence the encoding of the whole.

``tiktoken`` encodes the leaves.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts up to this many characters, and matches up to this many bytes, are encoded at once.
LEAF = 8192
_BORDER = regex.compile(r"(?<=\S)(?=\s)")


class BytePairs:
    """Encoder and decoder for one file of ranks and one splitting pattern."""

    def __init__(self, rank_lines: bytes, pattern: str, leaf: int = LEAF):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_lines.splitlines() if line)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.leaf = leaf
        self.bytes_of = {i: b for b, i in ranks.items()}

    # texts -------------------------------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; an empty text has none."""
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        begin, width = 0, 64
        while True:  # growing windows of the left half that hold a border
            found = [m.start() for m in _BORDER.finditer(left, max(len(left) - width, 0))]
            if found or width >= len(left):
                begin = found[-1] if found else 0
                break
            width *= 2
        m = _BORDER.search(right)
        end = m.start() if m else len(right)
        old_left = len(left_ids) if begin == 0 else len(self._window(left[begin:]))
        old_right = len(right_ids) if end == len(right) else len(self._window(right[:end]))
        fresh = self._window(left[begin:] + right[:end])
        return left_ids[: len(left_ids) - old_left] + fresh + right_ids[old_right:]

    def _window(self, text: str) -> list[int]:
        """Ids of a window; long matches in it go down a tree of their own."""
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        ids: list[int] = []
        for m in self.pieces.finditer(text):
            ids += self.encode_match(m.group().encode())
        return ids

    # one match ---------------------------------------------------------------------------------
    def encode_match(self, match: bytes) -> list[int]:
        if len(match) <= self.leaf:
            return self.core._encode_single_piece(match)
        middle = len(match) // 2
        return self.join_match(self.encode_match(match[:middle]), self.encode_match(match[middle:]))

    def join_match(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            fresh = self.core._encode_single_piece(self.decode(a) + self.decode(b))
            left_done = width >= len(left) or fresh[0] == a[0]
            right_done = width >= len(right) or fresh[-1] == b[-1]
            if left_done and right_done:
                return left[: len(left) - len(a)] + fresh + right[len(b) :]
            width *= 2

    # decoding ----------------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ``ids``; halves are decoded and concatenated."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])

    def checked(self, text: str) -> list[int]:
        """Ids of ``text``; raises if decoding them does not give it."""
        ids = self.encode(text)
        if self.decode(ids) != text.encode():
            raise ValueError("decoded ids are not the text they were made of")
        return ids


@cache
def _loaded(name: str, pattern: str, leaf: int) -> BytePairs:
    with open(SparkFiles.get(name), "rb") as f:
        return BytePairs(f.read(), pattern, leaf)


def ship(df: DataFrame, path: str) -> str:
    """Send a vocabulary file to all executors; its name there. Files are of a fixed size."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", leaf: int = LEAF, checked: bool = False) -> DataFrame:
    """``docs`` with the ids of each whole text as array<int> in ``ids_col``, replacing one of that name.

    Null and empty texts give an empty array. Rows, repeated ones too, and all other columns stay.
    No shuffle: each text is encoded where it is read; ``checked`` decodes its ids there and raises if they are not the text.
    """
    name = ship(docs, rank_file)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        coder = _loaded(name, pattern, leaf)
        one = coder.checked if checked else coder.encode
        return pa.array([one(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", bytes_col: str = "bytes", leaf: int = LEAF) -> DataFrame:
    """``encoded`` with the bytes of its ids; a null array gives empty bytes."""
    name = ship(encoded, rank_file)

    @F.arrow_udf("binary")
    def data(ids: pa.Array) -> pa.Array:
        coder = _loaded(name, pattern, leaf)
        return pa.array([coder.decode(x or []) for x in ids.to_pylist()], pa.binary())

    return encoded.withColumn(bytes_col, data(F.col(ids_col)))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Digests of each text's ids and of their decoding, made in one pass so that ids never leave the worker.

    Returns the id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256. Null and empty texts have no ids; every input row gives one row.
    """
    name = ship(docs, rank_file)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(name, pattern, leaf)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids = coder.encode(value.as_py() or "")
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{id_col}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
