"""All pairs of rows: groups of one side, each in a task of its own, that read the other side piece by piece."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, groups: int, slots: int = 1) -> DataFrame:
    """(side, columns of ``rows``), a task for each group of left rows (side 0) and slot of right rows (side 1), which come last.

    Rows are dealt by a hash of their id. Every group gets all right rows, a slot to each of its tasks.
    The number of a task is the partition's, so none holds two and none is merged with another.
    """
    at = F.xxhash64("id")
    slot, group = F.pmod(at, F.lit(slots)), F.pmod(F.shiftrightunsigned(at, 20), F.lit(groups))
    left = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.struct((group * slots + s).cast("int").alias("task"), F.lit(0).alias("side")))
    right = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.struct((g * slots + slot).cast("int").alias("task"), F.lit(1).alias("side")))
    both = rows.select(F.explode(F.concat(left, right)).alias("at"), *rows.columns).select("at.task", "at.side", *rows.columns)
    return both.repartitionById(groups * slots, "task").sortWithinPartitions("side").drop("task")


def sides(batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], piece: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of all left rows of a task, then those of its right rows in pieces; nothing if it has no left rows."""
    left: list[tuple[np.ndarray, ...]] = []
    given = False
    for batch in batches:
        first = int((batch.column(0).to_numpy() == 0).sum())
        if first:
            left.append(tuple(v.copy() for v in arrays(batch.slice(0, first))))
        if first == batch.num_rows or not left:
            continue
        if not given:
            given = True
            yield tuple(np.concatenate(v) for v in zip(*left))
        for s in range(first, batch.num_rows, piece):
            yield arrays(batch.slice(s, piece))
