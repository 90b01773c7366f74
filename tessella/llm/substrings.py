"""Removal of long repeated word sequences by seeds and extension.

Seeds are winnowed anchors: of the 16-word hashes inside a window of ``length`` words the first of the
smallest is the window's anchor, so equal windows have equal anchors at the same distance. A run is
the stretch of windows with one anchor in one place: the anchor extended both ways as far as it
governs. No two windows of a run are equal, for they hold the anchor at different distances. Runs are
joined on their anchors, never in pairs:

* A run whose whole content recurs is repeated throughout; one row for each run decides that.
* Where runs with one anchor differ in content, the repeat ends inside them. There, and only there,
  single windows are compared, with one run standing for all of equal content.

The union of repeated windows over a document is its set of maximal repeats of at least ``length``
words. All counting is by partial sums, so a passage in a third of all documents stays spread out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import Slice, Words, mix64, slices, window_hashes, word_hashes, words
from tessella.session import materialize

ANCHOR_WORDS = 16
_PER_DOCUMENT = 1 << 31


def sliding_first_min(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first smallest value of each ``width`` neighbours is."""
    have, low, at = 1, x, np.arange(len(x))
    while have < width:
        step = min(have, width - have)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def runs_of(part: Slice, length: int, anchor: int) -> tuple[np.ndarray, ...] | None:
    """(text, first window, windows, anchor, content) of every run in a slice, or None."""
    found = words(part)
    if len(found.starts) < length:
        return None
    hashes = word_hashes(part, found, lower=False)
    grams = window_hashes(hashes, anchor)
    seed = sliding_first_min(grams, length - anchor + 1)
    each = window_hashes(hashes, length)
    size = np.diff(found.bounds) - length + 1
    text = np.flatnonzero(size > 0)
    if not len(text):
        return None
    size = size[text]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = at + np.repeat(found.bounds[:-1][text], size)
    owner = np.repeat(text, size)
    seed, each = seed[place], each[place]
    first = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))  # texts do not share places
    count = np.diff(np.append(first, len(seed)))
    step = np.arange(len(seed), dtype=np.uint64) - np.repeat(first, count).astype(np.uint64)
    content = mix64(np.add.reduceat(mix64(each + step * np.uint64(0x9E3779B97F4A7C15)), first) + count.astype(np.uint64))
    return owner[first], at[first], count, grams[seed[first]], content


def _runs(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in slices(batch.column(1)):
                got = runs_of(part, length, anchor)
                if got:
                    owner, at, count, low, content = got
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part.first : part.last][owner]), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(low.astype(np.int64)), pa.array(content.astype(np.int64))],
                        ["doc", "at", "count", "anchor", "content"],
                    )

    return run


def _windows(length: int):
    """From (doc, text, [(at, count, weight)]) to rows (doc, at, weight, x, y): two hashes of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for part in slices(batch.column(1)):
                found = words(part)
                x = window_hashes(word_hashes(part, found, False), length)
                y = window_hashes(word_hashes(part, found, False, second=True), length)
                doc, at, weight, place = [], [], [], []
                for i in range(part.first, part.last):
                    for w in wanted[i]:
                        span = np.arange(w["at"], w["at"] + w["count"])
                        place.append(span + found.bounds[i - part.first])
                        at.append(span)
                        doc.append(np.full(len(span), ids[i]))
                        weight.append(np.full(len(span), w["weight"]))
                if place:
                    p = np.concatenate(place)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(doc)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(weight).astype(np.int32)), pa.array(x[p].astype(np.int64)), pa.array((y[p] >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                        ["doc", "at", "weight", "x", "y"],
                    )

    return run


def repeated_spans(docs: DataFrame, length: int = 35, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """(doc, spans): for each document (doc, text) with repeated windows, where they start and how many follow."""
    base = docs.where("doc is not null")
    runs = base.mapInArrow(_runs(length, anchor), "doc long, at int, count int, anchor long, content long")
    kinds = materialize(_kinds(runs))
    flagged = materialize(runs.join(kinds, ["anchor", "content"]))
    whole = flagged.where("copies > 1").select("doc", "at", "count")
    mixed = flagged.where("kinds > 1")
    occurrence = (F.col("doc").cast("decimal(38,0)") * F.lit(_PER_DOCUMENT) + F.col("at")).cast("decimal(38,0)")
    single = mixed.where("copies = 1").select("doc", "at", "count", F.lit(1).alias("weight"))
    one = mixed.where("copies > 1").groupBy("anchor", "content").agg(F.min(occurrence).alias("o"), F.min("count").alias("count"))
    one = one.select(
        F.floor(F.col("o") / _PER_DOCUMENT).cast("long").alias("doc"), F.pmod("o", F.lit(_PER_DOCUMENT)).cast("int").alias("at"), "count", F.lit(2).alias("weight")
    )
    wanted = single.union(one).groupBy("doc").agg(F.collect_list(F.struct("at", "count", "weight")).alias("wanted"))
    windows = materialize(
        base.join(wanted.hint("shuffle_hash"), "doc").select("doc", "text", "wanted").mapInArrow(_windows(length), "doc long, at int, weight int, x long, y int")
    )
    recurring = windows.groupBy("x", "y").agg(F.sum("weight").alias("n")).where("n > 1").select("x", "y")
    hits = windows.where("weight = 1").join(recurring, ["x", "y"]).select("doc", "at", F.lit(1).alias("count"))
    return whole.union(hits).groupBy("doc").agg(F.collect_list(F.struct("at", "count")).alias("spans"))


def _kinds(runs: DataFrame) -> DataFrame:
    """(anchor, content, copies, kinds) of anchors that occur more than once."""
    kinds = materialize(runs.groupBy("anchor", "content").agg(F.count("*").alias("copies")))
    per_anchor = kinds.groupBy("anchor").agg(F.sum("copies").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    return kinds.join(per_anchor.select("anchor", "kinds"), "anchor")


def covered(spans: list, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words a window starting in ``spans`` covers."""
    edge = np.zeros(n + length + 1, np.int64)
    for s in spans:
        edge[s["at"]] += 1
        edge[s["at"] + s["count"] + length - 1] -= 1
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """Texts without the words that repeated windows of ``length`` words cover.

    A window is repeated if its words also start anywhere else, in the same document too; windows are judged on
    the input. Returns the id, n_words, n_removed and kept_text (kept words joined by one space). Null
    and empty texts have no words. Ids are integers; a row without one takes no part and keeps
    its words. Repeated rows are copies of each other. Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    spans = repeated_spans(base, length)
    joined = base.join(spans.hint("shuffle_hash"), "doc", "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                ws = (text.as_py() or "").encode().split()
                n = len(ws)
                if spans.is_valid:
                    keep = np.flatnonzero(~covered(spans.as_py(), length, n))
                    ws = [ws[i] for i in keep]
                n_words.append(n)
                n_removed.append(n - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [id_col, "n_words", "n_removed", "kept_text"],
            )

    return joined.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept_text string")
