"""Centring of columns and scaling by the range of the whole matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    means: list[float]
    low: float
    high: float


def matrix(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): ids as long and components as double, so that no sum is taken in single precision."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))


def column_stats(m: DataFrame) -> DataFrame:
    """(dim from 0, n, mean, low, high) of each column; partial sums precede the shuffle of D rows a task."""
    return m.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def gather_stats(m: DataFrame) -> Stats:
    """Stats on the driver, D numbers. Rows that are null, ragged or hold what is no finite number raise."""
    bad = F.col("id").isNull() | F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    row = m.agg(F.sum(bad.cast("long")), F.min(F.size("x")), F.max(F.size("x")), F.count("*")).first()
    if not row[3]:
        raise ValueError("the matrix has no rows")
    if row[0]:
        raise ValueError(f"{row[0]} rows are null or hold null or non-finite components")
    if row[1] != row[2]:
        raise ValueError(f"rows are ragged: {row[1]} to {row[2]} components")
    stats = sorted(column_stats(m).collect(), key=lambda r: r["dim"])
    low, high = min(r["low"] for r in stats), max(r["high"] for r in stats)
    if low == high:
        raise ValueError("all components are equal: there is no range to scale by")
    return Stats([r["mean"] for r in stats], low, high)


def normalize(m: DataFrame, stats: Stats | None = None) -> DataFrame:
    """(id, f) with f = (x - column mean) / (largest - smallest component of the whole matrix)."""
    stats = stats or gather_stats(m)
    means = F.array(*[F.lit(v) for v in stats.means])
    return m.select("id", F.zip_with("x", means, lambda v, mean: (v - mean) / F.lit(stats.high - stats.low)).alias("f"))
