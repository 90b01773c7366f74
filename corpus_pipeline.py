"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bytepair, lines, minhash, mixing, toxicity
from tessella.session import discard, fresh_names, load, materialize

#: Documents with a score of this or more are rejected.
TOXIC = 0.5


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``; n_chars follows the text, where there is one."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the toxic ones, by a network that learns from all of ``labels`` (a bounded sample).

    Every row is scored, null and empty texts too; repeated rows go or stay together.
    """
    (score,) = fresh_names(docs, "toxicity")
    net = toxicity.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, score_col=score).where(F.col(score) < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses all its lines stays with an empty text.

    Null texts stay null, rows without an id stay as they are, repeated rows are cut alike.
    """
    # columns named like the operator's own results keep their values
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_removed")]
    aside = dict(zip(own, fresh_names(docs, *own)))
    out = lines.dedup_lines(docs.withColumnsRenamed(aside)).drop("n_lines", "n_removed")
    return _like(docs, out.withColumnsRenamed({v: k for k, v in aside.items()}))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; of repeated rows (one id and one text), one.

    Rows without an id have no partners and stay, as do null and empty texts.
    """
    (kept,) = fresh_names(docs, "kept_id")
    ids = minhash.near_duplicates(docs, num=80, den=100).where("kept").select(F.col("doc_id").alias(kept)).distinct()
    joined = docs.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col(kept), "left")
    known = joined.where(F.col(kept).isNotNull()).dropDuplicates(["doc_id", "text"])
    return known.union(joined.where("doc_id is null")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each row, with an id or not, appears once for each time it is taken, the last one cut
    to its words. Documents without words are not taken."""
    row, taken_row, taken, size, copy = fresh_names(docs, "row", "taken_row", "taken_words", "row_words", "copy")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    mixed = mixing.mix(numbered.select("doc_id", "source", "text", row), row_col=row).where("taken > 0")
    mixed = mixed.select(F.col(row).alias(taken_row), F.col("taken").alias(taken), F.col("size").alias(size))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col(taken) / F.col(size))))
    out = numbered.join(mixed.select("*", copies.alias(copy)).hint("shuffle_hash"), F.col(row) == F.col(taken_row))
    words = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(1)), 1, words.cast("int")), " ")
    return _like(docs, out.withColumn("text", F.when(words == F.col(size), F.col("text")).otherwise(part)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the byte-level BPE ids of each document of the mix, checked by decoding them."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bytepair.encode(docs.select("doc_id", "source", "text"), ranks, pattern, checked=True)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", clean),
    ("line dedup", dedup_lines),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: The network's scores and the byte pairs are not for SQL to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
