"""Affinities: precision of each row's kernel by bisection, conditional and joint probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import Affinities


def kernel_entropy(d2: np.ndarray, beta: float, units: str) -> tuple[np.ndarray, float]:
    """Weights exp(-d2 beta) and their entropy; "mixed" units add natural units to bits."""
    p = np.exp(-d2 * beta)
    total = p.sum()
    if not total > 0:  # every weight is too small for a double: the limit of one neighbour left
        return p, 0.0
    mean = beta * (d2 * p).sum() / total
    return p, float(np.log2(total) + (mean / np.log(2) if units == "bits" else mean))


def calibrate(d2: np.ndarray, target: float, tolerance: float, rounds: int, units: str) -> tuple[float, float]:
    """(beta, entropy) by doubling or halving towards a bracket and bisecting in it."""
    beta, low, high = 1.0, 0.0, np.inf
    entropy = kernel_entropy(d2, beta, units)[1]
    for _ in range(rounds):
        if abs(entropy - target) <= tolerance:
            break
        if entropy > target:
            low = beta
            beta = beta * 2 if np.isinf(high) else (low + high) / 2
        else:
            high = beta
            beta = (low + high) / 2
        entropy = kernel_entropy(d2, beta, units)[1]
    return beta, entropy


def gauss_kernel(edges: DataFrame, beta=1.0) -> DataFrame:
    """(i, total, entropy) of the kernel over each row's edges, by partial sums."""
    w = F.exp(-F.col("d2") * beta)
    return edges.groupBy("i").agg(F.sum(w).alias("total"), F.sum(F.col("d2") * w).alias("moment")).select(
        "i", "total", (F.log2("total") + F.lit(beta) * F.col("moment") / F.col("total")).alias("entropy")
    )


def precision(edges: DataFrame, settings: Affinities) -> DataFrame:
    """(i, beta, entropy): one row's edges are a bounded list, gathered and bisected in Arrow batches."""
    lists = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "d2"))).alias("e")).select("i", F.col("e.d2").alias("d2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [calibrate(d.values.to_numpy(zero_copy_only=False), settings.entropy, settings.tolerance, settings.rounds, settings.units) for d in batch.column(1)]
            beta, entropy = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(beta, pa.float64()), pa.array(entropy, pa.float64())], ["i", "beta", "entropy"])

    return lists.mapInArrow(run, "i long, beta double, entropy double")


def conditional(edges: DataFrame, beta: DataFrame) -> DataFrame:
    """(i, j, p): weights of each row's edges, with sum 1."""
    w = edges.join(beta.select("i", "beta"), "i").withColumn("w", F.exp(-F.col("d2") * F.col("beta")))
    total = w.groupBy("i").agg(F.sum("w").alias("total"))
    return w.join(total, "i").select("i", "j", (F.col("w") / F.col("total")).alias("p"))


def joint(cond: DataFrame, n: int) -> DataFrame:
    """(i, j, p): mean of both directions over the number of rows; all pairs together sum to 1."""
    a, b = F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")
    half = cond.select(a, b, "p").groupBy("a", "b").agg((F.sum("p") / (2 * n)).alias("p"))
    return half.select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("e"), "p").select("e.i", "e.j", "p")
