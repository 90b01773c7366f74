"""Mixing sources to target weights by an exact cut in a random order.

Each document gets a key from a hash of its id; within a source, documents in key order form a random
permutation that reruns repeat. The key's leading bits are range buckets: sizes are summed per bucket,
a prefix sum over the buckets finds the one in which the source's budget ends, and only that bucket
is sorted. No document order is ever gathered in one place, whatever share of rows a source holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Leading bits of the key that make a range bucket.
BUCKET_BITS = 12


def word_count(text) -> F.Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple], weights: tuple, share: float, most: float) -> list[float]:
    """Words due from each source: ``share`` of all words by weight, none above ``most`` times its own.

    ``sizes`` lists (source, words). What a full source cannot take is shared again among the others
    by weight until no target is above its bound.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    due = [0.0] * len(sizes)
    left = share * sum(n for _, n in sizes)
    heavy = float(sum(w for w, (_, n) in zip(weight, sizes) if n))
    level = 0.0
    # those that fill up at the lowest level first; once one does not fill up, none after it does
    for i in sorted((i for i, (_, n) in enumerate(sizes) if n), key=lambda i: (most * sizes[i][1] / weight[i], i)):
        level = level or left / heavy
        if most * sizes[i][1] / weight[i] < level:
            due[i] = most * sizes[i][1]
            left, heavy, level = left - due[i], heavy - weight[i], 0.0
        else:
            due[i] = weight[i] * level
    return due


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, row_col: str | None = None) -> DataFrame:
    """How much of each document the mix takes.

    Sources in order of code points, null last, weigh ``weights`` in turn. Returns the id, source, size
    (words), source_size, target (of its source) and taken (words, repeats counted). A source's taken
    words sum to its target rounded to a word: whole epochs first, then documents in key order, the last one
    in part. A source without words has target 0. Rows with equal ids are separate documents; null texts
    have size 0; an empty table gives an empty result; other columns are not read,
    but for ``row_col``, which tells rows apart and is returned too.
    """
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("null")))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    own = [row_col] if row_col else []
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias("row") for c in own])
    # rows are kept apart by their key; equal ids are told apart by size alone, which is all that counts
    base = materialize(base.withColumn("key", key).withColumn("bucket", F.shiftright("key", 60 - BUCKET_BITS)))
    per_bucket = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    per_source = per_bucket.groupBy("source").agg(F.sum("words").alias("words")).collect()  # one row a source
    order = sorted(per_source, key=lambda r: (r["source"] is None, r["source"] or ""))
    due = targets([(r["source"], r["words"]) for r in order], weights, share, most)
    rows = []
    for r, target in zip(order, due):
        n, whole = r["words"], math.floor(target + 0.5)
        rows.append((r["source"], n, target, whole // n if n else 0, whole % n if n else 0))
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, epochs long, rest long")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2**BUCKET_BITS rows a source
    starts = per_bucket.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.join(plan, starts.source.eqNullSafe(plan.source)).select(
        starts.source, "bucket", "start", "words", "source_size", "target", "epochs", "rest"
    )
    b = base.alias("b")
    s = starts.alias("s")
    joined = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.bucket") == F.col("s.bucket"))).select(
        "b.id", "b.source", "b.size", "b.key", "b.bucket", "start", "words", "source_size", "target", "epochs", "rest", *["b.row" for _ in own]
    )
    out = ["id", "source", "size", "source_size", "target", *["row" for _ in own]]
    whole = F.col("epochs") * F.col("size")
    cut = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("words") > F.col("rest"))
    clear = joined.where(~cut).select(
        *out, (whole + F.when(F.col("start") + F.col("words") <= F.col("rest"), F.col("size")).otherwise(0)).alias("taken")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", *["row" for _ in own]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = joined.where(cut).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    edge = ranked.select(*out, (whole + part).alias("taken"))
    both = clear.union(edge).withColumnRenamed("row", row_col) if row_col else clear.union(edge)
    return both.withColumnRenamed("id", id_col).withColumnRenamed("source", source_col)
