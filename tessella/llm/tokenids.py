"""Token ids of whole texts in compressed, checksummed files, and back.

Documents are range-partitioned by id; each partition becomes one file, whose name is the partition's
number, written under another name and renamed, so a task that runs again leaves the same file. Files
are in the order of ids; where each begins among all ids is a running sum over one number a file.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import rangecoder
from tessella.llm.text import LOWER, Slice, slices
from tessella.session import shared_dir

#: Distinct words whose ids a worker remembers, some 150 MB.
REMEMBERED = 1 << 20


#: Words that go through the library at a time, with a character between that no other word has.
TOGETHER = 64
_BETWEEN = "\x01"

# bytes: 1 letters and digits, 2 other signs of ASCII, but for the apostrophe, which can stand with the letters after it
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0


def _is_plain(word: str) -> bool:
    return word.isascii() and word.isalpha() and word.islower()


def _parted(part: Slice) -> pa.LargeStringArray:
    """The texts of a slice with A-Z as a-z, and with a space wherever a letter or digit meets another sign.

    The vocabulary has lower case alone and no pieces over such places, so ids stay the same and fewer words are
    distinct. Texts with a special token's bracket, which hold for one spelling only, or with combining marks stay as
    they are: some letters and marks are one character in lower case alone.
    """
    data, offsets = part.data, part.offsets
    odd = np.flatnonzero((data == 0xCC) | (data == 0xCD) | ((data == 60) & (np.append(data[1:], 0)[: len(data)] == 124)))
    same = np.zeros(len(offsets), bool)
    same[np.searchsorted(offsets, odd, "right") - 1] = True
    kind = _KIND[data]
    cuts = np.flatnonzero((kind[1:] ^ kind[:-1]) == 3) + 1
    data = LOWER[data]
    if len(odd):
        cuts = cuts[~same[np.searchsorted(offsets, cuts, "right") - 1]]
        for i in np.flatnonzero(same).tolist():
            data[offsets[i] : offsets[i + 1]] = part.data[offsets[i] : offsets[i + 1]]
    data = np.insert(data, cuts, np.uint8(32))
    offsets = offsets + np.searchsorted(cuts, offsets, "left")
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


class WordTokens:
    """Ids of texts by a vocabulary whose pieces never reach over white space.

    ASCII white space ends every piece and gives no id, so a text's ids are those of its words in a
    row; each distinct word goes through the library once. The vocabulary is of lower case. As in the library's plain call, special
    tokens written out in a text are those tokens; they hold no white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_file(path)
        (self.between,) = self.core.encode(_BETWEEN, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words in a row, number of each word's ids); words of a-z alone, all of which are one piece, come first."""
        plain = sum(map(_is_plain, words))
        tokens = [[t.id for t in self.core.model.tokenize(w)] for w in words[:plain]]
        ids, sizes = self._encode_any(words[plain:])
        plain_ids = np.array([i for t in tokens for i in t], np.uint16)
        return np.concatenate([plain_ids, ids]), np.concatenate([np.array([len(t) for t in tokens], np.int64), sizes])

    def _encode_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        batches = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        joined = [f" {_BETWEEN} ".join(batch) for batch in batches]
        for batch, text in zip(batches, joined):
            if text.count(_BETWEEN) == len(batch) - 1:
                got = np.array(self.core.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
                ends = np.append(np.flatnonzero(got == self.between), len(got))
                ids.append(got[got != self.between])
                sizes.append(np.diff(ends, prepend=-1) - 1)
            else:
                each = [self.core.encode(w, add_special_tokens=False).ids for w in batch]
                ids.append(np.array([i for e in each for i in e], np.uint16))
                sizes.append(np.array([len(e) for e in each]))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, part: Slice, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice in a row, number of each text's ids); ``end`` follows each text."""
        if len(self.index) > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(_parted(part))
        every = split.values.dictionary_encode()
        distinct = every.dictionary.to_pylist()
        fresh = [w for w in distinct if w not in self.index]
        if fresh:
            fresh.sort(key=_is_plain, reverse=True)
            ids, sizes = self._encode(fresh)
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            self.flat = np.concatenate([self.flat, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        known = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        word = known[every.indices.to_numpy()]
        size = self.offsets[word + 1] - self.offsets[word]
        run = np.concatenate([[0], np.cumsum(size)])
        edge = split.offsets.to_numpy()
        count = run[edge[1:]] - run[edge[:-1]]
        at = np.repeat(self.offsets[word] - run[:-1], size)
        at += np.arange(run[-1])
        after = np.cumsum(count + 1)
        ids = np.full(after[-1], end, np.uint16)
        inner = np.ones(len(ids), bool)
        inner[after - 1] = False
        ids[inner] = self.flat[at]
        return ids, count + 1


@cache
def _tokens(name: str) -> WordTokens:
    return WordTokens(SparkFiles.get(name))


def write(docs: DataFrame, vocabulary: str, folder: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents, in the order of their ids, to ``folder``; the manifest of its files.

    Null texts are empty and get the end alone; null document ids come first; equal ids go by their text. The
    manifest has path, start (ids in the files before), n_docs and n_ids; partitions without rows have no file.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokens(name)
        documents, ids = [], []
        for batch in batches:
            keys = batch.column(0)
            for part in slices(batch.column(1), 1 << 24):
                own = keys.slice(part.first, part.last - part.first)
                got, count = coder.encode(part, end)
                doc = np.zeros(len(count), rangecoder._DOC)
                doc["id"], doc["null"], doc["n"] = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), count
                documents.append(doc)
                ids.append(got)
        if documents:
            number = TaskContext.get().partitionId()
            doc, flat = np.concatenate(documents), np.concatenate(ids)
            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            path, draft = f"{root}/part-{number:06d}.tsr", f"{root}/.{number:06d}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                f.write(rangecoder.pack(doc, flat))
            store.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([f"{folder}/part-{number:06d}.tsr"]), pa.array([len(doc)]), pa.array([len(flat)])], ["number", "path", "n_docs", "n_ids"])

    files = sorted(base.mapInArrow(run, "number long, path string, n_docs long, n_ids long").collect())  # one row a file
    rows, start = [], 0
    for r in files:
        rows.append((r["path"], start, r["n_docs"], r["n_ids"]))
        start += r["n_ids"]
    return spark.createDataFrame(rows, "path string, start long, n_docs long, n_ids long")


def read(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, ids (array<int>, unsigned below 65536)."""
    return _read(manifest, True)


def digest(manifest: DataFrame) -> DataFrame:
    """As ``read``, without the ids themselves."""
    return _read(manifest, False)


def _read(manifest: DataFrame, full: bool) -> DataFrame:
    n = max(manifest.count(), 1)
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if full else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place) as f:
                    documents, ids = rangecoder.unpack(f.read())
                size = documents["n"].astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(size)])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edge[:-1], edge[1:])]
                columns = [pa.array(documents["id"].copy(), mask=documents["null"] == 1), pa.array(start + edge[:-1]), pa.array(size), pa.array(crc, pa.int64())]
                if full:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(edge, pa.int64()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return manifest.select("path", "start").repartitionByRange(n, "path").mapInArrow(run, kind)


def folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return shared_dir(spark)
