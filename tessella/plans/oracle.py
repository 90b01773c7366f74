"""DuckDB statements with the rows of the registered queries, built from shared common tables."""

from __future__ import annotations

from tessella.config import Affinities, Config, Forest, Gradient
from tessella.functions import lcg
from tessella.operators import cells
from tessella.operators.forest import projection
from tessella.operators.layout import seed_expression

K = Config().affinities.neighbours
TERMS = Forest().terms
#: Splits that the statements write out: enough for 100,000 rows.
DEPTH = 15

MATRIX = "e AS MATERIALIZED (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS x FROM embeddings)"
CELLS = "c AS (SELECT id, generate_subscripts(x, 1) - 1 AS dim, unnest(x) AS v FROM e)"
NORMAL = (
    f"{MATRIX}, {CELLS}, "
    "me AS (SELECT dim, avg(v) AS mean FROM c GROUP BY dim), ra AS (SELECT max(v) - min(v) AS wide FROM c), "
    "m AS MATERIALIZED (SELECT id, list((v - mean) / wide ORDER BY dim) AS f FROM c JOIN me USING (dim), ra GROUP BY id)"
)
GAP = "list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
KNN = (
    f"{NORMAL}, pa AS (SELECT a.id AS i, b.id AS j, {GAP} AS d2 FROM m a JOIN m b ON a.id <> b.id), "
    f"kn AS MATERIALIZED (SELECT * FROM (SELECT i, j, d2, (row_number() OVER (PARTITION BY i ORDER BY d2, j))::INTEGER AS rank FROM pa) WHERE rank <= {K})"
)
GRAPH = f"{KNN}, g AS MATERIALIZED (SELECT i, j, min(d2) AS d2 FROM (SELECT i, j, d2 FROM kn UNION ALL SELECT j, i, d2 FROM kn) GROUP BY i, j)"


def _sql(text: str) -> str:
    """An expression in the spelling of DuckDB: no suffix on doubles, whole numbers as BIGINT."""
    return text.replace(".0D", ".0::DOUBLE").replace("0.5D", "0.5::DOUBLE").replace("as int)", "as bigint)").replace(" id ", " id::BIGINT ")


def _entropy(d2: str, beta: str) -> str:
    return f"log2(sum(exp(-{d2} * {beta}))) + {beta} * sum({d2} * exp(-{d2} * {beta})) / sum(exp(-{d2} * {beta}))"


def _betas() -> str:
    a = Affinities()
    goal = f"log2({a.perplexity}::DOUBLE)"
    up, down = f"h - {goal} > {a.tolerance}", f"{goal} - h > {a.tolerance}"
    new = "CASE WHEN up THEN CASE WHEN isinf(hi) THEN beta * 2 ELSE (beta + hi) / 2 END ELSE (lo + beta) / 2 END"
    return (
        f"{GRAPH}, b(t, i, beta, lo, hi, h) AS ("
        f"SELECT 0, i, 1.0::DOUBLE, 0.0::DOUBLE, 'infinity'::DOUBLE, {_entropy('d2', '1.0::DOUBLE')} FROM g GROUP BY i UNION ALL "
        f"SELECT t + 1, n.i, nb, nl, nh, {_entropy('g.d2', 'nb')} FROM ("
        f"SELECT t, i, {new} AS nb, CASE WHEN up THEN beta ELSE lo END AS nl, CASE WHEN up THEN hi ELSE beta END AS nh "
        f"FROM (SELECT *, {up} AS up FROM b WHERE t < {a.rounds} AND ({up} OR {down}))) n JOIN g ON g.i = n.i GROUP BY t, n.i, nb, nl, nh), "
        "be AS MATERIALIZED (SELECT i, arg_max(beta, t) AS beta, arg_max(h, t) AS entropy FROM b GROUP BY i), "
        "co AS MATERIALIZED (SELECT g.i, j, exp(-d2 * beta) / sum(exp(-d2 * beta)) OVER (PARTITION BY g.i) AS p FROM g JOIN be ON be.i = g.i), "
        "jo AS MATERIALIZED (SELECT a.i, a.j, (a.p + b.p) / (2 * (SELECT count(*) FROM m)) AS p FROM co a JOIN co b ON a.i = b.j AND a.j = b.i)"
    )


def _layout(dims: int) -> str:
    start = _sql(seed_expression(1))
    return f"y AS MATERIALIZED (SELECT id, " + ", ".join(f"{_sql(lcg.normal(start, k))} AS y{k}" for k in range(dims)) + " FROM (SELECT vec_id::BIGINT AS id FROM embeddings))"


def _tree(trees: int, leaf: int) -> str:
    h = _sql(projection(lambda i: f"list_extract(f, {i})", 64, TERMS, 0)).replace("(tree *", "(tree::BIGINT *")
    parts = [f"{NORMAL}, t0 AS (SELECT id, f, tree, 1::BIGINT AS node FROM m, (SELECT unnest(range({trees})) AS tree))"]
    for d in range(DEPTH):
        parts.append(
            f"t{d + 1} AS MATERIALIZED (SELECT id, f, tree, CASE WHEN c * 0.7::DOUBLE > {leaf} THEN node * 2 + (r * 2 > c)::BIGINT ELSE node END AS node FROM ("
            f"SELECT *, count(*) OVER (PARTITION BY tree, node) AS c, row_number() OVER (PARTITION BY tree, node ORDER BY {h}, id) AS r FROM t{d}))"
        )
    parts.append(
        f"tr AS MATERIALIZED (SELECT tree, id, node, CASE WHEN count(*) OVER (PARTITION BY tree, node) >= {leaf} OR node = 1 THEN node ELSE node // 2 END AS bucket FROM t{DEPTH})"
    )
    parts.append(
        "ca AS MATERIALIZED (SELECT DISTINCT a.id AS i, b.id AS j FROM tr a JOIN (SELECT tree, id, node AS key FROM tr UNION SELECT tree, id, node // 2 FROM tr) b "
        "ON a.tree = b.tree AND a.bucket = b.key AND a.id <> b.id)"
    )
    return ", ".join(parts)


def _fill() -> str:
    start = f"{lcg.state('((i * 48271 + 11) % 2147483648)', 3)} % (SELECT count(*) FROM m)"
    return (
        f"nu AS (SELECT id AS j, row_number() OVER (ORDER BY id) - 1 AS number FROM m), "
        f"ha AS (SELECT id AS i, (SELECT count(*) FROM ca WHERE ca.i = m.id) AS have FROM m), "
        f"st AS (SELECT i, have, unnest(range({K} + 1)) AS step, {start} AS start FROM ha WHERE have < {K}), "
        f"fr AS (SELECT st.i, nu.j, have, row_number() OVER (PARTITION BY st.i ORDER BY step) AS r FROM st JOIN nu ON nu.number = (start + step) % (SELECT count(*) FROM m) "
        f"WHERE st.i <> nu.j AND NOT EXISTS (SELECT 1 FROM ca WHERE ca.i = st.i AND ca.j = nu.j)), "
        f"fi AS (SELECT i, j FROM fr WHERE r <= {K} - have)"
    )


CODED = (
    "si AS (SELECT 2 * greatest(max(abs(y0)), max(abs(y1))) AS size FROM y), "
    "q AS (SELECT id, y0, y1, least(floor(2147483648.0::DOUBLE * (y0 / size + 0.5::DOUBLE)), 2147483647)::BIGINT AS a, "
    "least(floor(2147483648.0::DOUBLE * (y1 / size + 0.5::DOUBLE)), 2147483647)::BIGINT AS b FROM y, si), "
    "mo AS MATERIALIZED (SELECT id, y0, y1, (SELECT sum((((a >> k) & 1) << (2 * k)) + (((b >> k) & 1) << (2 * k + 1))) FROM range(31) r(k))::BIGINT AS code FROM q)"
)
TREE = (
    "lv AS MATERIALIZED (SELECT level::INTEGER AS level, code >> (2 * (31 - level)) AS cell, count(*) AS n, avg(y0) AS c0, avg(y1) AS c1, min(id) AS own "
    "FROM mo, range({}) r(level) GROUP BY 1, 2)"
)
ATTRACT = (
    "att AS MATERIALIZED (SELECT e.i AS id, -12.0::DOUBLE * sum(w * (s.y0 - t.y0)) AS a0, -12.0::DOUBLE * sum(w * (s.y1 - t.y1)) AS a1 FROM "
    "(SELECT jo.*, p / (1 + (u.y0 - v.y0) * (u.y0 - v.y0) + (u.y1 - v.y1) * (u.y1 - v.y1)) AS w FROM jo JOIN y u ON u.id = i JOIN y v ON v.id = j) e "
    "JOIN y s ON s.id = e.i JOIN y t ON t.id = e.j GROUP BY e.i)"
)
REPULSE = (
    "re AS MATERIALIZED (SELECT id, sum(q * q * x0) AS f0, sum(q * q * x1) AS f1, sum(q) AS z FROM (SELECT s.id, 1 / (1 + (s.y0 - t.y0) * (s.y0 - t.y0) "
    "+ (s.y1 - t.y1) * (s.y1 - t.y1)) AS q, s.y0 - t.y0 AS x0, s.y1 - t.y1 AS x1 FROM y s JOIN y t ON s.id <> t.id) GROUP BY id)"
)
GRADIENT = "gr AS MATERIALIZED (SELECT id, a0 + f0 / total AS g0, a1 + f1 / total AS g1 FROM re JOIN att USING (id), (SELECT sum(z) AS total FROM re))"


def _barnes_hut() -> str:
    near = "(s.size / 2 / (1 << f.level)) * (s.size / 2 / (1 << f.level)) < 0.25::DOUBLE * ((y.y0 - l.c0) * (y.y0 - l.c0) + (y.y1 - l.c1) * (y.y1 - l.c1))"
    return (
        f"{_layout(2)}, {CODED}, {TREE.format(32)}, "
        "de(id, level, cell) AS (SELECT id, 0, 0::BIGINT FROM y UNION ALL "
        "SELECT f.id, k.level, k.cell FROM de f JOIN lv l ON l.level = f.level AND l.cell = f.cell JOIN y ON y.id = f.id, si s, lv k "
        f"WHERE k.level = f.level + 1 AND k.cell >> 2 = f.cell AND l.n > 1 AND NOT {near}), "
        f"hi AS (SELECT f.id, y.y0 - l.c0 AS x0, y.y1 - l.c1 AS x1, l.n FROM de f JOIN lv l ON l.level = f.level AND l.cell = f.cell JOIN y ON y.id = f.id, si s "
        f"WHERE NOT (l.n = 1 AND l.own = f.id) AND (l.n = 1 OR {near})), "
        "qq AS (SELECT *, 1 / (1 + x0 * x0 + x1 * x1) AS q FROM hi)"
    )


def _charges() -> str:
    basis = ["(u - 0.5) * (u - 5.0 / 6) / (2.0 / 9)", "(u - 1.0 / 6) * (u - 5.0 / 6) / (-1.0 / 9)", "(u - 1.0 / 6) * (u - 0.5) / (2.0 / 9)"]
    rows = " UNION ALL ".join(f"SELECT id, {k} AS k, {j} AS j, b, {w.replace('.0', '.0::DOUBLE').replace('0.5', '0.5::DOUBLE')} AS w FROM pl WHERE k = {k}" for k in range(2) for j, w in enumerate(basis) if True)
    return (
        f"{_layout(2)}, bo AS (SELECT least(min(y0), min(y1)) AS low, greatest(max(y0), max(y1)) AS high, 50 AS boxes FROM y), "
        "sc AS (SELECT id, 0 AS k, (y0 - low) / ((high - low) / boxes) AS s, boxes FROM y, bo UNION ALL SELECT id, 1, (y1 - low) / ((high - low) / boxes), boxes FROM y, bo), "
        "pl AS (SELECT id, k, least(floor(s), boxes - 1)::BIGINT AS b, CASE WHEN floor(s) >= boxes THEN 1 ELSE s - floor(s) END AS u FROM sc), "
        f"ba AS ({rows}), "
        "nd AS (SELECT a.id, (a.b * 3 + a.j) * 150 + b.b * 3 + b.j AS node, a.w * b.w AS w FROM ba a JOIN ba b ON a.id = b.id AND a.k = 0 AND b.k = 1)"
    )


def _with(tables: str, select: str) -> str:
    return f"WITH RECURSIVE {tables} {select}"


def _r(name: str, digits: int = 6) -> str:
    return f"round({name}, {digits}) + 0.0::DOUBLE AS {name}"


def statements() -> dict[str, str]:
    f = Forest()
    g = Gradient()
    forest, leaf = _tree(f.trees, f.leaf(K)), f.leaf(K)
    joint, y2 = _betas(), _layout(2)
    agree = lambda k: f"sign(g{k}) = sign(d{k})"
    gain = lambda k: f"CASE WHEN {agree(k)} THEN n{k} + 0.2 ELSE greatest(n{k} * 0.8, 0.01) END"
    state = "s AS (SELECT id, y0, y1, y0 * -0.01::DOUBLE AS d0, y1 * 0.01::DOUBLE AS d1, 1.0::DOUBLE AS n0, 0.011::DOUBLE AS n1 FROM y)"
    moved = f"u AS (SELECT id, y0, y1, {gain(0)} AS n0, {gain(1)} AS n1, d0, d1, g0, g1 FROM s JOIN gr USING (id)), v AS (SELECT id, y0, y1, n0, n1, 0.5::DOUBLE * d0 + 200.0::DOUBLE * n0 * g0 AS d0, 0.5::DOUBLE * d1 + 200.0::DOUBLE * n1 * g1 AS d1 FROM u)"
    knn_columns = f"i, j, rank, {_r('d2')}"
    raw = KNN.replace(NORMAL, f"{MATRIX}, m AS (SELECT id, x AS f FROM e)").replace(f"rank <= {K}", "rank <= 10")
    return {
        "col_stats": _with(f"{MATRIX}, {CELLS}", f"SELECT dim::INTEGER AS dim, count(v) AS n, {_r('avg(v)').replace('AS avg(v)', 'AS mean')}, {_r('min(v)').replace('AS min(v)', 'AS low')}, {_r('max(v)').replace('AS max(v)', 'AS high')} FROM c GROUP BY dim"),
        "normalize": _with(NORMAL, f"SELECT id, dim::INTEGER AS dim, {_r('value')} FROM (SELECT id, generate_subscripts(f, 1) - 1 AS dim, unnest(f) AS value FROM m)"),
        "knn_exact": _with(KNN, f"SELECT {knn_columns} FROM kn"),
        "topk_per_row": _with(raw, f"SELECT {knn_columns} FROM kn"),
        "sort_neighbours": _with(KNN, "SELECT i, string_agg(j::VARCHAR, ',' ORDER BY j) AS neighbours FROM kn GROUP BY i"),
        "knn_symmetric": _with(GRAPH, f"SELECT i, j, {_r('d2')} FROM g"),
        "lsh_tree": _with(forest, "SELECT tree, id, node, bucket FROM tr"),
        "lsh_candidates": _with(forest, "SELECT i, j FROM ca"),
        "random_fill": _with(f"{_tree(2, 30)}, {_fill()}", "SELECT i, j FROM fi"),
        "knn_lsh": _with(
            f"{forest}, {_fill()}, al AS (SELECT i, j FROM ca UNION ALL SELECT i, j FROM fi), pa AS (SELECT i, j, {GAP} AS d2 FROM al JOIN m a ON a.id = i JOIN m b ON b.id = j)",
            f"SELECT {knn_columns} FROM (SELECT i, j, d2, (row_number() OVER (PARTITION BY i ORDER BY d2, j))::INTEGER AS rank FROM pa) WHERE rank <= {K}",
        ),
        "gauss_kernel": _with(GRAPH, f"SELECT i, {_r('total')}, {_r('entropy')} FROM (SELECT i, sum(exp(-d2)) AS total, {_entropy('d2', '1.0::DOUBLE')} AS entropy FROM g GROUP BY i)"),
        "perplexity_beta": _with(joint, f"SELECT i, {_r('beta')}, {_r('entropy')} FROM be"),
        "affinity_conditional": _with(joint, "SELECT i, j, round(p, 9) AS p FROM co"),
        "affinity_joint": _with(joint, "SELECT i, j, round(p, 12) AS p FROM jo"),
        "init_random": _with(_layout(3), f"SELECT id, {_r('y0')}, {_r('y1')}, {_r('y2')} FROM y"),
        "attractive_step": _with(f"{joint}, {y2}, {ATTRACT}", f"SELECT id, {_r('a0', 9)}, {_r('a1', 9)} FROM att"),
        "repulsion_exact": _with(f"{y2}, {REPULSE}", f"SELECT id, {_r('f0')}, {_r('f1')}, {_r('z')} FROM re"),
        "bh_morton": _with(f"{y2}, {CODED}", "SELECT id, code FROM mo"),
        "bh_cells": _with(f"{y2}, {CODED}, {TREE.format(9)}", f"SELECT level, cell, n, {_r('c0')}, {_r('c1')} FROM lv"),
        "repulsion_bh": _with(_barnes_hut(), "SELECT id, round(sum(n * q * q * x0), 6) + 0.0::DOUBLE AS f0, round(sum(n * q * q * x1), 6) + 0.0::DOUBLE AS f1, round(sum(n * q), 6) + 0.0::DOUBLE AS z FROM qq GROUP BY id"),
        "pi_boxes": _with(_charges(), "SELECT boxes::INTEGER AS boxes, round(low, 6) AS low, round(high, 6) AS high, round((high - low) / boxes, 6) AS width FROM bo"),
        "pi_charges": _with(
            _charges(),
            f"SELECT node, {_r('w0')}, {_r('w1')}, {_r('w2')}, {_r('w3')} FROM (SELECT node, sum(w) AS w0, sum(w * y0) AS w1, sum(w * y1) AS w2, sum(w * (y0 * y0 + y1 * y1)) AS w3 FROM nd JOIN y USING (id) GROUP BY node)",
        ),
        "gradient_step": _with(f"{joint}, {y2}, {ATTRACT}, {REPULSE}, {GRADIENT}", f"SELECT id, {_r('g0', 9)}, {_r('g1', 9)} FROM gr"),
        "update_step": _with(
            f"{joint}, {y2}, {ATTRACT}, {REPULSE}, {GRADIENT}, {state}, {moved}",
            f"SELECT id, round(y0 + d0, 6) + 0.0::DOUBLE AS y0, round(y1 + d1, 6) + 0.0::DOUBLE AS y1, {_r('d0')}, {_r('d1')}, {_r('n0')}, {_r('n1')} FROM v",
        ),
        "schedule": f"SELECT t::INTEGER AS t, round(CASE WHEN t < 250 THEN 12 - 11 / (1 + exp(-0.05::DOUBLE * (t - 200))) ELSE 1 END, 6) + 0.0::DOUBLE AS exaggeration, "
        f"CASE WHEN t < 250 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS momentum, 200.0::DOUBLE AS eta FROM range({g.iterations}) r(t)",
        "io_binary_roundtrip": _with(f"{MATRIX}, {CELLS}", "SELECT id, dim::INTEGER AS dim, round(v, 6) + 0.0::DOUBLE AS value FROM c"),
        "io_csv": _with(y2, f"SELECT {_r('y0')}, {_r('y1')} FROM y"),
    }
