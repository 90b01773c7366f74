"""Queries of this subpackage over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import brown, bytepair, imatch, lines, minhash, mixing, neighbours, substrings, tokenids, toxicity
from tessella.llm.sql import ORACLES
from tessella.session import load


def crc_remainder(column: str, by: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return tokenids.digest(tokenids.write(load(spark, sf_dir, "documents"), vocabulary, tokenids.folder(spark)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytepair.round_trip(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels.where(crc_remainder("doc_id", 5) != 0))
    out = toxicity.score(docs, net)
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), k=5, num=85, den=100)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(load(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(load(spark, sf_dir, "documents"), held_out=crc_remainder("doc_id", 5) == 1)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_report(load(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
