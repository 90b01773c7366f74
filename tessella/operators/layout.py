"""Initial positions: reproducible normal draws, and the fold that follows earlier neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import lcg


def coordinates(dims: int) -> list[str]:
    return [f"y{k}" for k in range(dims)]


def seed_expression(seed: int) -> str:
    return f"((id * 7919 + {seed % 100003} * 104729 + 1) % 2147483648)"


def random_layout(ids: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """(id, y0, ...): standard normal coordinates that depend on the id and the seed alone."""
    start = seed_expression(seed)
    return ids.select("id", *[F.expr(lcg.normal(start, k)).alias(c) for k, c in enumerate(coordinates(dims))])


def _follow(y: np.ndarray, first: int, starts: np.ndarray, js: np.ndarray, ps: np.ndarray, scale: float) -> None:
    for i in range(first, first + len(starts) - 1):
        s, e = starts[i - first], starts[i - first + 1]
        j, p = js[s:e], ps[s:e]
        before = j < i
        if before.any():
            w = p[before]
            y[i] = y[i] / scale + w @ y[j[before]] / w.sum()


def follow(y: np.ndarray, starts: np.ndarray, js: np.ndarray, ps: np.ndarray) -> np.ndarray:
    """Fold over rows in order: a row with earlier neighbours shrinks and moves to their weighted mean."""
    y = y.copy()
    _follow(y, 0, starts, js, ps, len(y) ** (1 / y.shape[1]))
    return y


def smart_layout(layout: DataFrame, edges: DataFrame, dims: int) -> DataFrame:
    """(id, y0, ...) after the fold over ids in ascending order.

    Each row needs the rows before it, so this runs in one task. It reads rows in order, each with its edges to
    earlier ones, and keeps positions only.
    """
    cols = coordinates(dims)
    earlier = edges.where("j < i").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("e"))
    rows = layout.join(earlier, F.col("id") == F.col("i"), "left").select("id", *cols, F.col("e.j").alias("js"), F.col("e.p").alias("ps"))
    n = layout.count()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, at = np.empty(n, np.int64), np.empty((n, dims)), 0
        for batch in batches:
            m = batch.num_rows
            ids[at : at + m] = batch.column(0).to_numpy()
            for k in range(dims):
                y[at : at + m, k] = batch.column(k + 1).to_numpy()
            js, ps = batch.column(dims + 1), batch.column(dims + 2)
            size = np.nan_to_num(js.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            place = np.searchsorted(ids[: at + m], js.flatten().to_numpy(zero_copy_only=False))
            _follow(y, at, np.concatenate([[0], np.cumsum(size)]), place, ps.flatten().to_numpy(zero_copy_only=False), n ** (1 / dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(y[at : at + m, k]) for k in range(dims)]], ["id", *cols])
            at += m

    return rows.repartition(1).sortWithinPartitions("id").mapInArrow(fold, "id long, " + ", ".join(f"{c} double" for c in cols))
