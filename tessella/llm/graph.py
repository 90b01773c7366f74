"""Connected components and linking within blocks, as DataFrame joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.text import mix64
from tessella.session import discard, materialize

#: Blocks with more ids than this are compared with a leader first.
FEW = 32
#: Ids of a larger block that are compared with all of it before all others are.
LEADERS = 16
#: Links that a task contracts at a time.
CHUNK = 1 << 18


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest id.

    Alternates large-star and small-star steps until the edges stay as they are. Each step aggregates
    a minimum per node and joins it back; no adjacency list is ever gathered, so a hub is split by the
    skew join. Null ends and self links are left out; an empty input gives an empty result.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        parts = -(-mark[0] // CHUNK)  # tasks follow the number of links, not the width of shuffles
        spent = edges
        edges = edges.coalesce(parts)
        # large-star: each larger neighbour of a node goes to the node's smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        grown = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small-star: a node and its smaller neighbours go to the smallest of them
        grown = materialize(grown.coalesce(2 * parts).distinct().coalesce(parts))
        discard(spent)
        edges = grown
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(moved.union(least.select("u", F.col("m").alias("v"))).coalesce(2 * parts).distinct().coalesce(parts))
        discard(grown)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def contracted_components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """As ``connected_components``, for ids that are longs, in fewer stages.

    Tasks contract ``chunk`` links at a time to stars (union-find in an Arrow batch). Then the
    roots that an id has got from several chunks, at most one from each, are linked, and these fewer links
    are contracted in turn, until all that is left is one chunk. Roots are drawn by a hash, so chains
    of links shrink by a share at each level, in whatever order their ids are.
    """
    edges = materialize(links.where("a <> b").select("a", "b"))
    levels: list[DataFrame] = []
    while True:
        parts = max(1, -(-edges.count() // chunk))
        last = parts == 1
        local = edges.coalesce(parts).mapInArrow(_contract(chunk, None if last and not levels else len(levels)), "id long, root long, place long")
        if last:
            levels.append(materialize(local.select("id", "root")))
            break
        rows = materialize(local.groupBy("id").agg(F.min(F.struct("place", "root"))["root"].alias("root"), F.collect_set("root").alias("roots")))
        levels.append(rows.select("id", "root"))
        edges = materialize(rows.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b"))
    top = levels.pop()
    if not levels:
        return top.withColumnRenamed("root", "component")
    for below in reversed(levels):
        top = below.join(top.toDF("root", "top"), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    top = materialize(top)
    least = top.groupBy("root").agg(F.min("id").alias("component"))
    return top.join(least, "root").select("id", "component")


def _contract(chunk: int, salt: int | None):
    """Links to (id, root, place), ``chunk`` at a time; roots have the lowest place: a hash, or the id without a salt."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        place = ids if salt is None else (mix64(ids.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(1)).astype(np.int64)
        rank = np.argsort(np.argsort(place, kind="stable"), kind="stable")
        up = np.arange(len(ids)).tolist()

        def find(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        ends = rank[at].reshape(2, -1).tolist()  # numbered by place, so the smaller number is the root
        for x, y in zip(*ends):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        by_place = np.argsort(rank)
        root = by_place[[find(v) for v in rank.tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(place[root])], ["id", "root", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= chunk:
                yield stars(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield stars(*map(np.concatenate, zip(*held)))

    return run


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges: one small row."""
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000000007)).first()
    )


def link_blocks(members: DataFrame, verify: Callable[[DataFrame], DataFrame], may: Callable) -> DataFrame:
    """Components of the ids in ``members`` (block, id, payload), linking ids that share a block.

    ``may(x, y)`` is the condition on two rows, as functions from a column's name, for a pair to be a
    candidate; ``verify`` takes candidate pairs (a, b) with a < b and returns those that truly link.
    Blocks of up to ``FEW`` ids are joined with themselves; a larger block is compared with one leader
    first. Of these pairs each id's likeliest, that with the most blocks in common, is verified first. Then all other
    pairs are, unless their ids are in one component by then, and those of ``LEADERS`` ids with all of their larger
    block, which leaves few components in it. Last are all other pairs of larger blocks that are in different components still,
    each made once, in the first of the blocks that its ids share. So every true candidate is verified or linked otherwise.
    Returns (id, component) for ids that have a link.
    """
    counted = members.groupBy("block").agg(F.count("*").alias("m"))
    small = members.join(counted.where(F.col("m") <= FEW).select("block"), "block").withColumn("component", F.col("id"))
    big = materialize(members.join(counted.where(F.col("m") > FEW).select("block"), "block"))
    pairs = _crossing(small, may)
    crowded = big.limit(1).count() > 0
    if crowded:
        leader = big.groupBy("block").agg(F.min("id").alias("id"))
        leader = big.join(leader, ["block", "id"]).dropDuplicates(["block"]).withColumn("component", F.col("id"))
        pairs = pairs.union(_crossing(leader, may, big.withColumn("component", F.col("id"))))
    pairs = materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("shared")))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    links = materialize(verify(best))
    components = materialize(connected_components(links))

    def placed(rows: DataFrame, id_col: str, name: str) -> DataFrame:
        known = components.select(F.col("id").alias(id_col), F.col("component").alias(name))
        return rows.join(known, id_col, "left").withColumn(name, F.coalesce(name, id_col))

    def grown(more: DataFrame) -> DataFrame:
        if not more.limit(1).count():
            return components
        stars = components.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        return materialize(connected_components(stars.union(more)))

    def parted() -> DataFrame:
        """Rows of the larger blocks that have several components."""
        known = placed(big, "id", "component")
        several = known.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        return materialize(known.join(several.select("block"), "block"))

    rest = placed(placed(pairs.join(best, ["a", "b"], "left_anti"), "a", "x"), "b", "y").where("x <> y").select("a", "b")
    if crowded:
        known = parted()
        drawn = known.groupBy("block", F.pmod(F.xxhash64("id"), F.lit(LEADERS))).agg(F.min("id").alias("id")).select("block", "id")
        drawn = materialize(known.join(drawn.distinct(), ["block", "id"], "left_semi"))
        more = _crossing(drawn, may, known).union(_crossing(known, may, drawn)).distinct()
        rest = rest.union(more.join(pairs, ["a", "b"], "left_anti"))  # no pair is verified twice
        rest = materialize(rest)
    more = materialize(verify(rest))
    components = grown(more)
    if crowded:
        discard(more, known, drawn)
        known = parted()
        shared = known.groupBy("id").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
        tested = pairs.select("a", "b").union(rest)
        more = materialize(verify(_crossing(known.join(shared, "id"), _first_of(may)).join(tested, ["a", "b"], "left_anti")))
        components = grown(more)
        discard(known, rest)
    discard(big, pairs, links, more)
    return components


def _first_of(may: Callable) -> Callable:
    """``may`` in the first block only that both ``blocks``, all of a row's id in order, have in common."""
    return lambda a, b: may(a, b) & (F.element_at(F.array_intersect(a("blocks"), b("blocks")), 1) == a("block"))


def _crossing(left: DataFrame, may: Callable, right: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a, b), a < b, of two tables' rows in one block and different components."""
    x, y = left.alias("x"), (left if right is None else right).alias("y")
    found = x.join(y, F.col("x.block") == F.col("y.block")).where(
        (F.col("x.id") < F.col("y.id"))
        & (F.col("x.component") != F.col("y.component"))
        & may(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    )
    return found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
