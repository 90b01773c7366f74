"""DuckDB statements that give the same rows as the queries in ``registry``."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n,
         [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3] AS w,
         row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) AS i
  FROM d GROUP BY source),
f AS (
  SELECT *, 1.5 * (sum(n) OVER ())::DOUBLE
            - coalesce(sum(2.0 * n) OVER (ORDER BY 2.0 * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(w) OVER (ORDER BY 2.0 * n / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM s WHERE n > 0),
g AS (
  SELECT *, 2.0 * n / w < left_over / heavy AS filled,
         min(CASE WHEN NOT 2.0 * n / w < left_over / heavy THEN left_over / heavy END)
           OVER (ORDER BY 2.0 * n / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS least,
         first_value(left_over / heavy) OVER (PARTITION BY 2.0 * n / w < left_over / heavy ORDER BY 2.0 * n / w, i) AS level
  FROM f),
t AS (SELECT s.source, s.n, CASE WHEN s.n = 0 THEN 0.0::DOUBLE WHEN filled THEN 2.0::DOUBLE * s.n ELSE s.w * level END AS target
      FROM s LEFT JOIN g USING (i)),
r AS (
  SELECT d.doc_id, d.size, t.n, t.target, floor(t.target + 0.5)::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target::DOUBLE AS target,
       CASE WHEN n = 0 THEN 0 ELSE (whole // n) * size + greatest(0, least(size, whole % n - before)) END::BIGINT AS taken
FROM r
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b)
SELECT n.doc_id, n.n AS n_shingles, m.root AS component_id, n.doc_id = m.root AS kept
FROM n JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = n.doc_id
"""

REPEATS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, md5_number(array_to_string(ws[i:i + 34], ' ')) AS h FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)),
         lambda z: gone IS NULL OR NOT list_contains(gone, z[2])), lambda z: z[1]), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

NEAREST = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op3_nearest": NEAREST, "op5_minhash": NEAR, "op6_substrings": REPEATS, "op8_mixing": MIXING}
