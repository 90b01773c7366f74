"""Repulsion by interpolation on a grid: boxes, charges, convolution, potentials."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import Interpolation
from tessella.functions.kernels import box_count, convolve
from tessella.operators.layout import coordinates


@dataclass(frozen=True)
class Boxes:
    low: float
    high: float
    count: int

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.count


def boxes(layout: DataFrame, dims: int, settings: Interpolation) -> Boxes:
    """One range over all coordinates, cut into boxes."""
    cols = [F.col(c) for c in coordinates(dims)]
    row = layout.agg(F.min(F.least(*cols, cols[0])), F.max(F.greatest(*cols, cols[0]))).first()
    if row[0] is None or row[0] == row[1]:
        raise ValueError("all coordinates are equal: there is no range to cut into boxes")
    return Boxes(row[0], row[1], box_count(row[0], row[1], settings.least_boxes, settings.per_box))


def _basis(place: Column, n: int, j: int) -> Column:
    """Value of the j-th Lagrange polynomial on the nodes (0.5 + l) / n of a box."""
    h = 1.0 / n
    top = reduce(lambda a, b: a * b, [place - F.lit((0.5 + m) * h) for m in range(n) if m != j], F.lit(1.0))
    return top / F.lit(float(np.prod([(j - m) * h for m in range(n) if m != j])))


def stencil(layout: DataFrame, dims: int, b: Boxes, n: int) -> DataFrame:
    """(id, y0, ..., node, w): each point's weights on the n**dims nodes of its box."""
    cols = coordinates(dims)
    at = layout
    for k, c in enumerate(cols):
        scaled = (F.col(c) - F.lit(b.low)) / F.lit(b.width)
        at = at.withColumn(f"b{k}", F.least(F.floor(scaled), F.lit(b.count - 1)).cast("long"))
        at = at.withColumn(f"u{k}", F.when(F.floor(scaled) >= b.count, F.lit(1.0)).otherwise(scaled - F.floor(scaled)))
    side = n * b.count
    entries = [(F.lit(0).cast("long"), F.lit(1.0))]
    for k in range(dims):
        entries = [
            (node * side + F.col(f"b{k}") * n + j, w * _basis(F.col(f"u{k}"), n, j)) for node, w in entries for j in range(n)
        ]
    nodes = F.array(*[F.struct(node.alias("node"), w.alias("w")) for node, w in entries])
    return at.select("id", *cols, F.explode(nodes).alias("e")).select("id", *cols, "e.node", "e.w")


def charges(points: DataFrame, dims: int) -> DataFrame:
    """(node, w0, ...): sums of weight times 1, each coordinate, and the squared norm."""
    cols = coordinates(dims)
    norm = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols])
    terms = [F.lit(1.0), *[F.col(c) for c in cols], norm]
    return points.groupBy("node").agg(*[F.sum(F.col("w") * t).alias(f"w{k}") for k, t in enumerate(terms)])


def interpolated_repulsion(layout: DataFrame, dims: int, settings: Interpolation) -> DataFrame:
    """(id, f0, ..., z): repulsion from potentials on the grid; z is the row's part of the sum.

    Charges are partial sums per node. The grid's size follows the layout's spread, not its rows; it is
    convolved on the driver, and its occupied nodes join the stencil again.
    """
    spark = layout.sparkSession
    b = boxes(layout, dims, settings)
    side = settings.points * b.count
    points = stencil(layout, dims, b, settings.points)
    table = charges(points, dims).toArrow()
    node = table.column("node").to_numpy()
    dense = np.zeros((dims + 2, side**dims))
    for k in range(dims + 2):
        dense[k, node] = table.column(f"w{k}").to_numpy()
    phi = convolve(dense.reshape((dims + 2,) + (side,) * dims), b.width / settings.points).reshape(dims + 2, -1)[:, node]
    kind = "node long, " + ", ".join(f"v{k} double" for k in range(dims + 2))
    potentials = spark.createDataFrame(pa.table([pa.array(node), *[pa.array(p) for p in phi]], names=[c.split()[0] for c in kind.split(", ")]))
    cols = coordinates(dims)
    got = points.join(potentials, "node").groupBy("id", *cols).agg(*[F.sum(F.col("w") * F.col(f"v{k}")).alias(f"v{k}") for k in range(dims + 2)])
    norm = reduce(lambda a, c: a + c, [F.col(c) * F.col(c) for c in cols])
    cross = reduce(lambda a, c: a + c, [F.col(c) * F.col(f"v{k + 1}") for k, c in enumerate(cols)])
    z = (1 + norm) * F.col("v0") - 2 * cross + F.col(f"v{dims + 1}") - 1
    return got.select("id", *[(F.col(c) * F.col("v0") - F.col(f"v{k + 1}")).alias(f"f{k}") for k, c in enumerate(cols)], z.alias("z"))
