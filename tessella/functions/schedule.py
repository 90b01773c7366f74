"""Schedules: expressions of Iteration and Iterations, evaluated by Spark SQL once for all steps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = {"ceiling": "ceil", "max": "greatest", "min": "least", "truncate": "bigint", "ieeeremainder": "mod", "log10": "log10"}


class Schedule:
    """A number for each step: a text expression, or a callable of (step, steps)."""

    def __init__(self, source: str | Callable[[int, int], float]):
        self.source = source

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schedule) and self.source == other.source

    def __hash__(self) -> int:
        return hash(self.source)

    def sql(self) -> str:
        """The expression in SQL. ``Log(x, base)`` has its arguments the other way round there."""
        if callable(self.source):
            raise TypeError("a callable has no SQL form")
        text = re.sub(r"\bLog\(([^(),]+),([^(),]+)\)", r"log(\2, \1)", self.source, flags=re.I)
        return re.sub(r"\b([A-Za-z_]\w*)\s*\(", lambda m: f"{_NAMES.get(m[1].lower(), m[1].lower())}(", text)

    def column(self) -> Column:
        return F.expr(self.sql()).cast("double")


def schedule_table(spark: SparkSession, iterations: int, **schedules: Schedule) -> DataFrame:
    """One row for each step: t and the value of each schedule."""
    steps = spark.range(iterations).select(F.col("id").cast("int").alias("t"))
    plain = {k: s for k, s in schedules.items() if not callable(s.source)}
    out = steps.withColumns({"Iteration": F.col("t"), "Iterations": F.lit(iterations)})
    out = out.select("t", *[s.column().alias(k) for k, s in plain.items()])
    called = {k: s.source for k, s in schedules.items() if callable(s.source)}
    if called:
        rows = [(t, *[float(f(t, iterations)) for f in called.values()]) for t in range(iterations)]
        more = spark.createDataFrame(rows, "t int, " + ", ".join(f"`{k}` double" for k in called))
        out = out.join(more, "t")
    return out.select("t", *schedules)
