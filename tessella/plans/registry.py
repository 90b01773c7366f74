"""Registered queries over the given tables; ``oracle`` has their SQL counterparts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import Affinities, Config, Forest, Gradient, Initialization, Interpolation
from tessella.functions.schedule import schedule_table
from tessella.operators import affinity, cells, forces, forest, grid, knn, layout, normalize
from tessella.plans import oracle
from tessella.plans.reducer import Reducer
from tessella.session import load, materialize, shared_dir
from tessella.sources import matrix

K = Config().affinities.neighbours
DIGITS = 6


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.matrix(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised rows, dealt over all cores: one file would be one task."""
    m = _matrix(spark, sf_dir)
    return normalize.normalize(m).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    # adding zero turns a negative zero into zero
    return df.withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in names})


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(knn.symmetric(knn.exact_knn(_normal(spark, sf_dir), K)))


def _layout(spark: SparkSession, sf_dir: str, dims: int = 2) -> DataFrame:
    return layout.random_layout(_matrix(spark, sf_dir), dims, seed=1)


def _joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)
    beta = materialize(affinity.precision(edges, Affinities()))
    return materialize(affinity.joint(affinity.conditional(edges, beta), _matrix(spark, sf_dir).count()))


def col_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(normalize.column_stats(_matrix(spark, sf_dir)).select("dim", "n", "mean", "low", "high"), "mean", "low", "high")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.normalize(_matrix(spark, sf_dir)).select("id", F.posexplode("f").alias("dim", "value"))
    return _rounded(out, "value")


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.exact_knn(_normal(spark, sf_dir), K).select("i", "j", "rank", "d2"), "d2")


def topk_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir).withColumnRenamed("x", "f")
    return _rounded(knn.exact_knn(m, 10).select("i", "j", "rank", "d2"), "d2")


def sort_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = knn.sorted_neighbours(knn.exact_knn(_normal(spark, sf_dir), K))
    return out.select("i", F.array_join("neighbours", ",").alias("neighbours"))


def knn_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(knn.symmetric(knn.exact_knn(_normal(spark, sf_dir), K)).select("i", "j", "d2"), "d2")


def lsh_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = materialize(_normal(spark, sf_dir))
    f = Forest()
    return forest.trees(m, m.count(), f.leaf(K), f, "median").select("tree", "id", "node", "bucket")


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = materialize(_normal(spark, sf_dir))
    f = Forest()
    return forest.candidates(forest.trees(m, m.count(), f.leaf(K), f, "median"))


def random_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = materialize(_normal(spark, sf_dir))
    n, f = m.count(), Forest(trees=2)
    found = materialize(forest.candidates(forest.trees(m, n, 30, f, "median")))
    return forest.random_fill(m, found, n, K)


def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = materialize(_normal(spark, sf_dir))
    return _rounded(forest.forest_knn(m, K, Forest(), "median").select("i", "j", "rank", "d2"), "d2")


def gauss_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(affinity.gauss_kernel(_graph(spark, sf_dir)), "total", "entropy")


def perplexity_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(affinity.precision(_graph(spark, sf_dir), Affinities()), "beta", "entropy")


def affinity_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)
    return affinity.conditional(edges, affinity.precision(edges, Affinities())).select("i", "j", F.round("p", 9).alias("p"))


def affinity_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joint(spark, sf_dir).select("i", "j", F.round("p", 12).alias("p"))


def init_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_layout(spark, sf_dir, 3), "y0", "y1", "y2")


def init_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.smart_layout(_layout(spark, sf_dir), _joint(spark, sf_dir), 2)


def attractive_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forces.attraction(_joint(spark, sf_dir), materialize(_layout(spark, sf_dir)), 2, 12.0)
    return out.select("id", *[(F.round(f"a{k}", 9) + F.lit(0.0)).alias(f"a{k}") for k in range(2)])


def repulsion_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(forces.exact_repulsion(materialize(_layout(spark, sf_dir)), 2), "f0", "f1", "z")


def bh_morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.morton(_layout(spark, sf_dir), 2).select("id", "code")


def bh_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = materialize(cells.morton(_layout(spark, sf_dir), 2))
    return _rounded(cells.all_cells(coded, 2, 8), "c0", "c1")


def repulsion_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cells.barnes_hut(materialize(_layout(spark, sf_dir)), 2), "f0", "f1", "z")


def pi_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = grid.boxes(_layout(spark, sf_dir), 2, Interpolation())
    row = [(b.count, round(b.low, DIGITS), round(b.high, DIGITS), round(b.width, DIGITS))]
    return spark.createDataFrame(row, "boxes int, low double, high double, width double")


def pi_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, s = materialize(_layout(spark, sf_dir)), Interpolation()
    points = grid.stencil(y, 2, grid.boxes(y, 2, s), s.points)
    return _rounded(grid.charges(points, 2), "w0", "w1", "w2", "w3")


def repulsion_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.interpolated_repulsion(materialize(_layout(spark, sf_dir)), 2, Interpolation())


def gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = materialize(_layout(spark, sf_dir))
    pull = forces.attraction(_joint(spark, sf_dir), y, 2, 12.0)
    out = forces.gradient(pull, materialize(forces.exact_repulsion(y, 2)), 2)
    return out.select("id", *[(F.round(f"g{k}", 9) + F.lit(0.0)).alias(f"g{k}") for k in range(2)])


def update_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = materialize(_layout(spark, sf_dir))
    pull = forces.attraction(_joint(spark, sf_dir), y, 2, 12.0)
    grad = forces.gradient(pull, materialize(forces.exact_repulsion(y, 2)), 2)
    # last moves and gains that try each branch
    state = y.select(
        "id", "y0", "y1", *[(F.col(f"y{k}") * F.lit(0.01 * (1 if k else -1))).alias(f"d{k}") for k in range(2)],
        F.lit(1.0).alias("n0"), F.lit(0.011).alias("n1"),
    )
    return _rounded(forces.update(state, grad, 2, 0.5, 200.0, 0.01), "y0", "y1", "d0", "d1", "n0", "n1")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Gradient()
    out = schedule_table(spark, g.iterations, exaggeration=g.exaggeration, momentum=g.momentum, eta=g.rate)
    return _rounded(out, "exaggeration", "momentum", "eta")


def _reduce(method: str, dims: int, iterations: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # at the default perplexity and rate this structureless table contracts to a point
        base = Config(initialization=Initialization(seed=1), affinities=Affinities(perplexity=10.0))
        config = replace(base, gradient=Gradient(iterations=iterations, method=method))
        return Reducer(config).reduce(load(spark, sf_dir, "embeddings"), dims)

    query.__name__ = f"reduce_{dims}d"
    return query


def io_binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}.bin"
    m = _matrix(spark, sf_dir)
    matrix.write_vectors(m, path)
    back = matrix.read_matrix(spark, path)
    return back.select("id", F.posexplode("x").alias("dim", "value")).withColumn("value", F.round("value", DIGITS) + F.lit(0.0))


def io_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}.csv"
    matrix.write_csv(_layout(spark, sf_dir), ["y0", "y1"], path)
    back = spark.read.schema("y0 double, y1 double").csv(path)
    return _rounded(back, "y0", "y1")


def queries() -> dict:
    return {
        "col_stats": col_stats, "normalize": normalized, "knn_exact": knn_exact, "topk_per_row": topk_per_row,
        "sort_neighbours": sort_neighbours, "knn_symmetric": knn_symmetric, "lsh_tree": lsh_tree, "lsh_candidates": lsh_candidates,
        "random_fill": random_fill, "knn_lsh": knn_lsh, "gauss_kernel": gauss_kernel, "perplexity_beta": perplexity_beta,
        "affinity_conditional": affinity_conditional, "affinity_joint": affinity_joint, "init_random": init_random, "init_smart": init_smart,
        "attractive_step": attractive_step, "repulsion_exact": repulsion_exact, "bh_morton": bh_morton, "bh_cells": bh_cells,
        "repulsion_bh": repulsion_bh, "pi_boxes": pi_boxes, "pi_charges": pi_charges, "repulsion_pi": repulsion_pi,
        "gradient_step": gradient_step, "update_step": update_step, "schedule": schedule,
        "reduce_1d": _reduce("fft", 1, 1000), "reduce_2d": _reduce("fft", 2, 1000), "reduce_3d": _reduce("barnes_hut", 3, 250),
        "reduce_auto": _reduce("auto", 2, 250), "io_binary_roundtrip": io_binary_roundtrip, "io_csv": io_csv,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
