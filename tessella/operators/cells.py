"""Barnes-Hut repulsion: cells by Morton prefix, and the descent as joins level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.layout import coordinates
from tessella.session import materialize


def bits(dims: int) -> int:
    """Bits for each coordinate, so that a code fits 62 bits and doubles hold each part exactly."""
    return {1: 31, 2: 31, 3: 20}[dims]


def _spread(x: Column, dims: int) -> Column:
    """The bits of ``x`` with ``dims - 1`` zeros after each, by halving steps."""
    if dims == 1:
        return x
    steps = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
    if dims == 3:
        steps = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]
    for shift, mask in steps:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(layout: DataFrame, dims: int, size: float | None = None) -> DataFrame:
    """``layout`` with its code: coordinates quantised over [-size / 2, size / 2], bits interleaved."""
    cols = coordinates(dims)
    size = size or layout_size(layout, dims)
    top = 1 << bits(dims)
    parts = [F.least(F.floor(F.lit(float(top)) * (F.col(c) / F.lit(size) + 0.5)), F.lit(top - 1)).cast("long") for c in cols]
    code = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(_spread(p, dims), k) for k, p in enumerate(parts)])
    return layout.withColumn("code", code)


def layout_size(layout: DataFrame, dims: int) -> float:
    """Twice the largest absolute coordinate."""
    largest = layout.agg(F.max(F.greatest(*[F.abs(c) for c in coordinates(dims)], F.lit(0.0)))).first()[0]
    if not largest:
        raise ValueError("all positions are the origin: there is no extent to divide")
    return 2 * largest


def level_cells(coded: DataFrame, dims: int, level: int) -> DataFrame:
    """(cell, n, c0, ...): points and centre of mass of each cell of a level; the root is level 0."""
    cell = F.shiftright("code", dims * (bits(dims) - level)) if level else F.lit(0).cast("long")
    return coded.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{k}") for k, c in enumerate(coordinates(dims))])


def all_cells(coded: DataFrame, dims: int, deepest: int) -> DataFrame:
    """(level, cell, n, c0, ...) of levels 0 to ``deepest``."""
    parts = [level_cells(coded, dims, k).withColumn("level", F.lit(k)) for k in range(deepest + 1)]
    return reduce(DataFrame.unionByName, parts).select("level", "cell", "n", *[f"c{k}" for k in range(dims)])


def barnes_hut(layout: DataFrame, dims: int, condition: float = 0.5) -> DataFrame:
    """(id, f0, ..., z) with far cells taken as their centres of mass.

    A cell is taken if half its side is under ``condition`` times its distance. What is not taken goes to
    the next level; a cell of one point is that point, and the points of a cell at the last level count one
    by one. Points meet cells in a join per level, so neither the tree nor the layout is broadcast.
    """
    cols = coordinates(dims)
    size = layout_size(layout, dims)
    coded = materialize(morton(layout, dims, size))
    frontier = coded.select("id", *cols, F.lit(0).cast("long").alias("cell"))
    done = None
    last = bits(dims)
    for level in range(last + 1):
        if level < last:
            cells = level_cells(coded, dims, level)
        else:  # points of one code, each a cell of its own
            cells = coded.select(F.col("code").alias("cell"), F.lit(1).cast("long").alias("n"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(cols)], F.col("id").alias("own"))
        if level < last:
            single = coded.groupBy((F.shiftright("code", dims * (last - level)) if level else F.lit(0).cast("long")).alias("cell")).agg(F.min("id").alias("own"))
            cells = cells.join(single, "cell")
        half = size / 2 / (1 << level)
        met = frontier.join(cells, "cell")
        d2 = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"c{k}")) * (F.col(c) - F.col(f"c{k}")) for k, c in enumerate(cols)])
        met = materialize(met.withColumn("d2", d2).withColumn("take", (F.col("n") == 1) | (F.lit(half * half) < F.lit(condition**2) * F.col("d2"))))
        q = 1 / (1 + F.col("d2"))
        taken = met.where(F.col("take") & ~((F.col("n") == 1) & (F.col("own") == F.col("id"))))
        part = taken.groupBy("id").agg(
            *[F.sum(F.col("n") * q * q * (F.col(c) - F.col(f"c{k}"))).alias(f"f{k}") for k, c in enumerate(cols)], F.sum(F.col("n") * q).alias("z")
        )
        done = part if done is None else done.unionByName(part)
        rest = met.where(~F.col("take"))
        if level == last or rest.limit(1).count() == 0:
            break
        down = level_cells(coded, dims, level + 1).select(F.col("cell").alias("child"), F.shiftright("cell", dims).alias("cell"))
        frontier = rest.select("id", *cols, "cell").join(down, "cell").select("id", *cols, F.col("child").alias("cell"))
    total = done.groupBy("id").agg(*[F.sum(f"f{k}").alias(f"f{k}") for k in range(dims)], F.sum("z").alias("z"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in [f"f{k}" for k in range(dims)] + ["z"]]
    return layout.select("id").join(total, "id", "left").select("id", *zero)
