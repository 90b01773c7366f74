"""Document fingerprints by I-Match with randomised lexicons.

Terms are the distinct words of a text, A-Z folded. The lexicon keeps terms within a band of inverse
document frequency. A document's sorted distinct lexicon terms are hashed as a whole, and again over
randomised lexicon subsets: subset r at scale j keeps a term if a hash of the two falls into the lowest
2**-j. A document is fingerprinted at the scales around its number of terms, where subsets hold about
one term each, so the share of equal subset hashes follows the overlap of two texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import mix64, slices, word_hashes, words

#: Share of documents that a lexicon term is in: natural-log idf between 2.3 and 7.6.
RAREST, COMMONEST = 1 / 2000, 1 / 10
SUBSETS = 32
#: Distinct terms that a task gathers before it passes their counts on.
HELD = 1 << 20

_SEEDS = mix64(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def term_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    for part in slices(column):
        found = words(part)
        hashes = word_hashes(part, found, lower=True)
        for lo, hi in zip(found.bounds[:-1], found.bounds[1:]):
            yield np.unique(hashes[lo:hi])


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, df) over all documents (text); counts are summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            terms, df = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], ["term", "df"])

        for batch in batches:
            for s in term_sets(batch.column(0)):
                held.append(s)
                n += len(s)
                if n >= 4 * HELD:
                    yield out()
                    n = 0
        if held:
            yield out()

    return texts.mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> np.ndarray:
    """Sorted hashes of the terms in the band.

    A term of the band is in at least ``rarest`` of all documents, so there are at most
    (distinct terms of an average document) / ``rarest`` of them, however many documents there are.
    """
    n = docs.count()
    df = document_frequencies(docs.select(text_col)).where((F.col("df") >= F.lit(rarest * n)) & (F.col("df") <= F.lit(commonest * n)))
    found = df.select("term").toArrow().column("term").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def in_lexicon(terms: np.ndarray, lex: np.ndarray) -> np.ndarray:
    """Terms of the lexicon; all terms, if none is."""
    if not len(lex) or not len(terms):
        return terms
    at = np.searchsorted(lex, terms)
    at[at == len(lex)] = 0
    kept = terms[lex[at] == terms]
    return kept if len(kept) else terms


class Print:
    """Fingerprint of a set of terms: a hash of all, and subset hashes (0: no term) at three scales."""

    def __init__(self, terms: np.ndarray):
        mixed = mix64(terms)
        self.whole = int(mix64(np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(terms))]))[0])
        middle = max(1, math.ceil(math.log2(len(terms) + 1)))
        self.scales = (middle - 1, middle, middle + 1)
        draw = mix64(terms[None, :] ^ _SEEDS[:, None])
        rows = []
        for j in self.scales:
            inside = draw >> np.uint64(64 - j) == 0 if j else np.ones(draw.shape, bool)
            sums = np.where(inside, mixed[None, :], np.uint64(0)).sum(axis=1, dtype=np.uint64)
            rows.append(np.where(inside.any(axis=1), (sums >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0)))
        self.rows = np.stack(rows)

    def __str__(self) -> str:
        return f"{self.whole:016x}-{self.scales[0]:x}-{self.rows.astype('>u4').tobytes().hex()}"

    def likeness(self, other: Print) -> float:
        """Share of equal subset hashes among those that either has, over the common scales; 1 for equal sets."""
        if self.whole == other.whole:
            return 1.0
        same = either = 0
        for i, j in enumerate(self.scales):
            if j in other.scales:
                a, b = self.rows[i], other.rows[other.scales.index(j)]
                some = (a | b) != 0
                either += int(some.sum())
                same += int((some & (a == b)).sum())
        return same / either if either else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lex: np.ndarray | None = None) -> DataFrame:
    """The id and fingerprint of each document, without a shuffle beyond the lexicon's. Null texts are empty."""
    spread = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col) if lex is None else lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [str(Print(in_lexicon(t, spread.value))) for t in term_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edit, and how like they are to each other and to the next text.

    The edit replaces the last floor(n / 2) code points by the first as many (or all) of the next
    document by id; after the last comes the first. Null ids come first; equal ids go by their text.
    Null texts are empty. Documents are dealt into id ranges; the first of each range
    also goes, marked, to the range before, so each task sees every next document it needs.
    """
    spark = docs.sparkSession
    spread = spark.sparkContext.broadcast(lexicon(docs, text_col))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    base = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shares = [i / n for i in range(1, n)]
    row = base.agg(F.min("key").alias("low"), F.percentile_approx("key", shares or [0.5], 100 * n).alias("cuts")).first()
    if row["low"] is None:
        cuts = []
    else:
        cuts = sorted({c for c in (row["cuts"] if n > 1 else []) if c > row["low"]})
    # at most one number a partition: a document's range is how many cuts are at or below its key
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    rank = F.size(F.filter(edges, lambda c: c <= F.col("key")))
    first = F.when(F.col("key") == F.lit(row["low"]), F.lit(len(cuts))).when(F.array_contains(edges, F.col("key")), rank - 1)
    dealt = base.select("*", F.explode(F.array(F.struct(rank.alias("range"), F.lit(False).alias("spare")), F.struct(first.alias("range"), F.lit(True).alias("spare")))).alias("to"))
    dealt = dealt.where("to.range is not null").select("to.range", "to.spare", "key", "id", "text")
    dealt = dealt.repartitionByRange(n, "range").sortWithinPartitions("range", "spare", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = spread.value
        show = lambda texts: [Print(in_lexicon(t, lex)) for t in term_sets(pa.array(texts, pa.large_string()))]

        def finish(rows: list) -> pa.RecordBatch:
            """Rows (id, text, print) with the one that follows them last."""
            ids, texts, prints = zip(*rows)
            chars = [len(t) for t in texts]
            edits = [t[: c - c // 2] + texts[i + 1][: c // 2] for i, (t, c) in enumerate(zip(texts[:-1], chars))]
            after = show(edits)
            m = len(edits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:m], pa.int64()), pa.array(chars[:m], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
                    pa.array([str(p) for p in prints[:m]]), pa.array([str(p) for p in after]),
                    pa.array([p.likeness(q) for p, q in zip(prints, after)], pa.float64()),
                    pa.array([p.likeness(q) for p, q in zip(prints[:m], prints[1:])], pa.float64()),
                ],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        held: list = []
        size, now, done = 0, None, False
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for place, spare, ident, text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), texts, show(texts)):
                if place != now:
                    held, size, now, done = [], 0, place, False
                if done:
                    continue  # further texts of the id that follows
                held.append((ident, text, mark))
                size += len(text)
                if spare:
                    done = True
                if len(held) > 1 and (spare or size > 1 << 20):
                    yield finish(held)
                    held, size = held[-1:], len(text)

    out = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
