"""The embedding engine: queries beside SQL, approximations beside exact forces, whole reductions, files, settings."""

import subprocess
import sys
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from compare import connect, differences
from tessella.config import Affinities, Config, Forest, Gradient, Initialization, Interpolation, load_config
from tessella.functions import kernels
from tessella.functions.schedule import Schedule, schedule_table
from tessella.operators import cells, forces, forest, grid, knn, layout, normalize
from tessella.plans import reducer, registry
from tessella.plans.reducer import Reducer
from tessella.sources import matrix


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert differences(df, connect(sf_dir), registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_approximations_are_near_exact_forces(dims):
    y = np.random.default_rng(dims).standard_normal((300, dims))
    force, z = kernels.exact_repulsion(y)
    for method, tolerance in ((kernels.barnes_hut, 0.1), (kernels.interpolation, 1e-3)):
        f, total = method(y)
        assert abs(total / z - 1) < tolerance
        assert np.abs(f - force).max() < tolerance * np.abs(force).max()


def test_barnes_hut_takes_equal_points():
    y = np.repeat(np.random.default_rng(0).standard_normal((5, 2)), 4, axis=0)
    (f, z), (g, w) = kernels.barnes_hut(y, 0.0), kernels.exact_repulsion(y)
    assert np.allclose(f, g) and np.isclose(z, w)


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_barnes_hut_of_own_rows(monkeypatch, dims):
    y = np.random.default_rng(dims).standard_normal((240, dims))
    y[50:70] = y[3]
    force, z = kernels.barnes_hut(y)
    monkeypatch.setattr(kernels, "DESCEND", 50)
    parts = [kernels.barnes_hut(y, own=own) for own in (slice(0, 90), slice(90, 91), slice(91, 240))]
    assert np.array_equal(np.concatenate([f for f, _ in parts]), force) and np.isclose(sum(p for _, p in parts), z)
    for at in (5, 60, 200):  # the descent itself, a cell after the other
        assert np.allclose(_descend(y, at), force[at])


def _descend(y, at, condition=0.5):
    dims, size = y.shape[1], 2 * np.abs(y).max()
    bits = {1: 31, 2: 31, 3: 20}[dims]
    code = kernels.morton_codes(y, size, bits)
    total, cells = np.zeros(dims), [(0, np.arange(len(y)))]
    while cells:
        level, members = cells.pop()
        gap = y[at] - y[members].mean(axis=0)
        half = size / 2 / (1 << level)
        if len(members) == 1 or half * half < condition**2 * (gap @ gap):
            total += len(members) / (1 + gap @ gap) ** 2 * gap
        elif level == bits:
            for j in members:
                gap = y[at] - y[j]
                total += gap / (1 + gap @ gap) ** 2
        else:
            below = code[members] >> (dims * (bits - level - 1))
            cells += [(level + 1, members[below == c]) for c in np.unique(below)]
    return total


def clusters(spark, n=200):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 16)) * 2
    rows = [(i, (centres[i % 5] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("method", ["exact", "barnes_hut", "fft"])
def test_clusters_stay_together(spark, method):
    config = Config(initialization=Initialization(seed=1), affinities=Affinities(perplexity=10.0), gradient=Gradient(iterations=300, method=method))
    rows = Reducer(config).reduce(clusters(spark), 2).orderBy("id").collect()
    y = np.array([[r["y0"], r["y1"]] for r in rows])
    d2 = ((y[:, None] - y) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, axis=1)[:, :10]
    assert ((near % 5) == (np.arange(200) % 5)[:, None]).mean() > 0.95


def test_plan_per_step_equals_loop_in_one_task(spark):
    config = Config(initialization=Initialization(smart=False, seed=1), affinities=Affinities(perplexity=5.0), gradient=Gradient(iterations=2, method="fft"))
    df = clusters(spark, 60)
    a = {r["id"]: (r["y0"], r["y1"]) for r in Reducer(config).reduce(df, 2).collect()}
    b = {r["id"]: (r["y0"], r["y1"]) for r in Reducer(config, local_rows=0).reduce(df, 2).collect()}
    assert all(np.allclose(a[i], b[i], atol=1e-6) for i in a)


@pytest.mark.parametrize("method, dims, smart", [("fft", 2, True), ("barnes_hut", 3, False), ("exact", 1, False), ("auto", 2, False)])
def test_tasks_of_a_gang_equal_one_task(spark, monkeypatch, method, dims, smart):
    config = Config(initialization=Initialization(smart=smart, seed=1), affinities=Affinities(perplexity=5.0), gradient=Gradient(iterations=4, method=method))
    df = clusters(spark, 90)
    if method == "auto":  # which of them is the faster is settled here
        monkeypatch.setattr(reducer.kernels, "TRIES", 10)
    a = {r["id"]: [r[f"y{k}"] for k in range(dims)] for r in Reducer(config).reduce(df, dims).collect()}
    monkeypatch.setattr(reducer, "ALONE", 50)
    monkeypatch.setattr(reducer, "EACH", 30)
    monkeypatch.setattr(Reducer, "_distributed", None)  # a plan for each step took all the time
    b = {r["id"]: [r[f"y{k}"] for k in range(dims)] for r in Reducer(config).reduce(df, dims).collect()}
    assert reducer.gang_size(spark, 90) == 3 and len(b) == 90
    assert all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


@pytest.mark.parametrize("method, steps, want", [("exact", 2, ["exact"] * 2), ("barnes_hut", 1, ["barnes_hut"]), ("auto", 3, ["barnes_hut", "fft", "fft"])])
def test_plan_per_step_takes_the_method(spark, monkeypatch, method, steps, want):
    called = []
    real = {"exact": forces.exact_repulsion, "barnes_hut": cells.barnes_hut, "fft": grid.interpolated_repulsion}

    def spy(name):
        def run(y, dims, *rest):
            called.append(name)
            if method == "auto":  # which of them is the faster is settled here
                time.sleep(5 * (name == "barnes_hut"))
                return real["exact"](y, dims)
            return real[name](y, dims, *rest)

        return run

    monkeypatch.setattr(forces, "exact_repulsion", spy("exact"))
    monkeypatch.setattr(cells, "barnes_hut", spy("barnes_hut"))
    monkeypatch.setattr(grid, "interpolated_repulsion", spy("fft"))
    monkeypatch.setattr(kernels, "TRIES", 1)
    config = Config(initialization=Initialization(smart=False, seed=1), affinities=Affinities(perplexity=5.0), gradient=Gradient(iterations=steps, method=method))
    df = clusters(spark, 60)
    b = {r["id"]: (r["y0"], r["y1"]) for r in Reducer(config, local_rows=0).reduce(df, 2).collect()}
    assert called == want
    if method == "exact":
        a = {r["id"]: (r["y0"], r["y1"]) for r in Reducer(config).reduce(df, 2).collect()}
        assert all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


def test_forest_finds_most_neighbours_and_fills_up(spark):
    m = normalize.normalize(normalize.matrix(clusters(spark), "vec_id", "embedding")).cache()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = forest.forest_knn(m, 10, Forest()).select("i", "j").collect()
    want = {(r["i"], r["j"]) for r in knn.exact_knn(m, 10).collect()}
    assert len(found) == 2000
    assert len(want & {(r["i"], r["j"]) for r in found}) / len(want) > 0.6


def test_symmetric_graph_finds_neighbours_once(spark):
    m = spark.createDataFrame([(i, [float(i % 5), float(i % 7)]) for i in range(60)], "id long, f array<double>")
    near = knn.exact_knn(m, 4)
    got = knn.symmetric(near)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    edges = {(r["i"], r["j"], r["d2"]) for r in near.collect()}
    assert sorted(tuple(r) for r in got.collect()) == sorted(edges | {(j, i, d2) for i, j, d2 in edges})


@pytest.mark.parametrize("side", [1 << 20, 100])
def test_exact_neighbours_pass_no_blocks_on(spark, monkeypatch, side):
    monkeypatch.setattr(knn, "ROWS", 32)
    monkeypatch.setattr(knn, "PIECE", 40)
    monkeypatch.setattr(knn, "SIDE", side)
    x = np.random.default_rng(4).integers(0, 3, (330, 4)).astype(float)
    x[100:250] = x[0]  # more equal rows than neighbours
    got = knn.exact_knn(spark.createDataFrame([(5 * i, row) for i, row in enumerate(x.tolist())], "id long, f array<double>"), 7)
    plan = got._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    d2 = ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    want = {(5 * i, 5 * int(j), r + 1, d2[i, j]) for i in range(330) for r, j in enumerate(np.lexsort((np.arange(330), d2[i]))[:7])}
    assert {(r["i"], r["j"], r["rank"], r["d2"]) for r in got.collect()} == want


@pytest.mark.parametrize("split", ["median", "quantile"])
def test_equal_vectors_are_split_too(spark, split):
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i < 400 else [float(i % 7), float(i % 11), float(i % 13), 0.5]) for i in range(600)]
    m = spark.createDataFrame(rows, "id long, f array<double>")
    got = forest.trees(m, 600, 20, Forest(trees=3), split)
    assert got.count() == 1800
    sizes = [r["n"] for r in got.groupBy("tree", "bucket").count().withColumnRenamed("count", "n").collect()]
    assert max(sizes) < 120


def test_large_segments_are_split_by_aggregation(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((701, 8))
    x[100:420] = x[0]  # medians among equal projections
    rows = [(int(i), row) for i, row in zip(rng.permutation(701) * 3, x.tolist())]
    m = spark.createDataFrame(rows, "id long, f array<double>").repartition(3)
    whole = sorted(forest.trees(m, 701, 10, Forest(trees=5), "median").collect())
    monkeypatch.setattr(forest, "SEGMENT", 60)
    monkeypatch.setattr(forest, "DEALT", 701 * 8 * 16 * 2)  # two trees at once
    got = forest.trees(m, 701, 10, Forest(trees=5), "median")
    assert "Window" not in got._jdf.queryExecution().toString()  # which held a tree's vectors in one task
    assert sorted(got.collect()) == whole
    assert max(r["n"] for r in got.groupBy("tree", "node").agg(F.count("*").alias("n")).collect()) < 20


def test_forest_takes_distances_where_vectors_are(spark, monkeypatch):
    x = np.random.default_rng(7).integers(0, 4, (400, 6)).astype(float)
    m = spark.createDataFrame([(2 * i, row) for i, row in enumerate(x.tolist())], "id long, f array<double>").repartition(3)
    f = Forest(trees=6)
    want = knn.top_k(knn.distances(forest.candidates(forest.trees(m, 400, f.leaf(20), f)), m), 20)
    want = {(r["i"], r["j"], r["d2"], r["rank"]) for r in want.collect()}
    asked = []
    monkeypatch.setattr(knn, "distances", lambda pairs, m, real=knn.distances: asked.append(pairs.count()) or real(pairs, m))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = {(r["i"], r["j"], r["d2"], r["rank"]) for r in forest.forest_knn(m, 20, f).collect()}
    count = lambda pairs: np.bincount([p[0] // 2 for p in pairs], minlength=400)
    assert sum(asked) == (20 - count(want)).sum()  # random ones only: all candidates were joined with two vectors each
    assert (count(got) == 20).all() and all(got >= {p for p in want if p[0] == i} for i in 2 * np.flatnonzero(count(want) == 20))


def test_tasks_of_candidates_follow_their_number(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((300, 5))
    m = spark.createDataFrame(list(enumerate(x.tolist())), "id long, f array<double>").repartition(3)
    rows = forest.trees(m, 300, 4, Forest(trees=2))
    few = forest.candidates(rows)
    fill = sorted(forest.random_fill(m, few, 300, 20).collect())
    monkeypatch.setattr(forest, "TASK_PAIRS", 100)
    many = forest.candidates(rows)
    assert (many.rdd.getNumPartitions(), sorted(many.collect())) == (300 * 2 * 8 // 100 + 1, sorted(few.collect()))
    got = forest.random_fill(m, many, 300, 20)
    assert (got.rdd.getNumPartitions(), sorted(got.collect())) == (300 * 21 // 100 + 1, fill)


@pytest.mark.parametrize("spread, want", [(10.0, 50), (50.5, 50), (51.0, 55), (131.0, 140), (199.0, 200), (250.0, 250)])
def test_box_counts(spark, spread, want):
    y = spark.createDataFrame([(0, 0.0, 1.0), (1, spread, 0.5)], "id long, y0 double, y1 double")
    assert grid.boxes(y, 2, Interpolation()).count == want


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_plans_of_repulsion_agree(spark, dims):
    y = np.random.default_rng(dims).standard_normal((120, dims))
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(y.tolist())], "id long, " + ", ".join(f"y{k} double" for k in range(dims)))
    force, z = kernels.exact_repulsion(y)

    def forces_of(df):
        rows = df.orderBy("id").collect()
        return np.array([[r[f"f{k}"] for k in range(dims)] for r in rows]), sum(r["z"] for r in rows)

    f, total = forces_of(forces.exact_repulsion(table, dims))
    assert np.allclose(f, force) and np.isclose(total, z)
    f, total = forces_of(grid.interpolated_repulsion(table, dims, Interpolation()))
    assert abs(total / z - 1) < 1e-3 and np.abs(f - force).max() < 1e-3 * np.abs(force).max()


def test_exact_repulsion_is_dealt_over_tasks(spark):
    y = np.random.default_rng(2).standard_normal((2500, 2))
    y[7] = y[2400]
    got = forces.exact_repulsion(spark.createDataFrame([(3 * i, *row) for i, row in enumerate(y.tolist())], "id long, y0 double, y1 double"), 2)
    assert "Join" not in got._jdf.queryExecution().toString()
    rows = got.withColumn("task", F.spark_partition_id()).orderBy("id").collect()
    assert [r["id"] for r in rows] == [3 * i for i in range(2500)]
    assert np.bincount([r["task"] for r in rows]).max() < 1100  # one task had them all
    force, z = kernels.exact_repulsion(y)
    assert np.allclose([[r["f0"], r["f1"]] for r in rows], force, rtol=0, atol=1e-9) and np.isclose(sum(r["z"] for r in rows), z)


def test_start_follows_earlier_neighbours(spark):
    rng = np.random.default_rng(8)
    y = rng.standard_normal((30, 2))
    edges = [(i, j, float(rng.random())) for i in range(30) for j in rng.choice(30, 4, replace=False).tolist() if i != j]
    table = spark.createDataFrame([(3 * i, *row) for i, row in enumerate(y.tolist())], "id long, y0 double, y1 double")
    got = layout.smart_layout(table, spark.createDataFrame([(3 * i, 3 * j, p) for i, j, p in edges], "i long, j long, p double"), 2)
    want = {}
    for i in range(30):
        before = [(p, want[j]) for a, j, p in edges if a == i and j < i]
        want[i] = y[i] if not before else y[i] / 30**0.5 + sum(p * w for p, w in before) / sum(p for p, _ in before)
    assert all(np.allclose((r["y0"], r["y1"]), want[r["id"] // 3]) for r in got.collect())


def test_start_reads_rows_as_they_come(spark):
    rng = np.random.default_rng(9)
    y = rng.standard_normal((40, 2))
    edges = [(i, j, float(rng.random())) for i in range(40) for j in rng.choice(40, 5, replace=False).tolist() if i != j and i % 9]
    table = spark.createDataFrame([(7 * i, *row) for i, row in enumerate(y.tolist())], "id long, y0 double, y1 double").repartition(6)
    got = layout.smart_layout(table, spark.createDataFrame([(7 * i, 7 * j, p) for i, j, p in edges], "i long, j long, p double"), 2)
    assert "FlatMapGroups" not in got._jdf.queryExecution().analyzed().toString()  # which hold all rows and their edges at once
    want = {}
    for i in range(40):
        before = [(p, want[j]) for a, j, p in edges if a == i and j < i]
        want[i] = y[i] if not before else y[i] / 40**0.5 + sum(p * w for p, w in before) / sum(p for p, _ in before)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 40 and all(np.allclose((r["y0"], r["y1"]), want[r["id"] // 7]) for r in rows)


def test_queries_without_optional_libraries():
    code = "import sys; sys.modules['tiktoken'] = sys.modules['tokenizers'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert said == [str(len(registry.queries())), str(len(registry.oracle_sql()))]


def test_bad_input_raises(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(90)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too few"):
        Reducer().reduce(few)
    with pytest.raises(ValueError, match="dimension"):
        Reducer().reduce(few, 0)
    for rows in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, [float("nan"), 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [1.0])], [(1, [2.0]), (2, [2.0])], []):
        with pytest.raises(ValueError):
            normalize.gather_stats(normalize.matrix(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"))


def test_binary_files(spark, tmp_path):
    df = spark.createDataFrame([(i, [i + 0.5, -i / 4]) for i in range(7)], "id long, x array<double>")
    path = str(tmp_path / "m.bin")
    matrix.write_vectors(df, path)
    back = {r["id"]: r["x"] for r in matrix.read_matrix(spark, path, split=20).collect()}
    assert back == {i: [i + 0.5, -i / 4] for i in range(7)}
    with open(path, "r+b") as f:
        f.truncate(30)
    with pytest.raises(ValueError, match="too few"):
        matrix.read_matrix(spark, path)


def test_schedules(spark):
    rows = schedule_table(spark, 300, a=Gradient().exaggeration, b=Schedule(lambda t, n: t / n)).orderBy("t").collect()
    assert [round(rows[t]["a"], 4) for t in (0, 200, 250)] == [11.9995, 6.5, 1.0]
    assert rows[150]["b"] == 0.5


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"Affinities": {"EntropyTol": 0.001}, "Gradient": {"Iterations": 10, "RepulsionMethod": "fft"}, "Other": {"x": 1}}')
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        config = load_config(str(path))
    assert (config.affinities.perplexity, config.affinities.tolerance) == (30.0, 0.001)
    assert (config.gradient.iterations, config.gradient.method) == (10, "fft")
