"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Equal shingle sets collapse to their smallest id (two 64-bit sums over the set are the key).
2. Signatures of the rest are cut into bands; documents that share a band are candidates.
3. Candidates compare their signatures batch by batch. After m of n equal values the posterior of the
   similarity under a uniform prior is Beta(m + 1, n - m + 1); a pair goes as soon as the posterior
   probability of reaching the threshold is below ``MISS``.
4. Survivors are verified on their full shingle sets, and links are closed to components.

Bands shared by few documents give their pairs to a join. Bands shared by many do not: documents that
such bands connect form a crowd, which is first compared with a few leaders, and then, as far as it is
not one component yet, in tiles of two chunks of at most ``CHUNK`` documents or so. A tile tests its
pairs in place and returns no more links than it has documents; chunks that already belong to one
component are not compared with each other. So no group is gathered in one task, no pairs of a crowd
become rows, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import graph
from tessella.llm.text import mix64, shingle_sets, slices
from tessella.session import materialize

BANDS, ROWS = 25, 5
#: Signature values compared at a time.
STEP = 25
#: Chance to lose a pair at the threshold, at each of the steps.
MISS = 1e-6

#: Bands with more documents than this make a crowd.
FEW = 32
LEADERS = 8
CHUNK = 256

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each permutation over a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (_A[:, None] * x[None, i : i + 2048] + _B[:, None]).min(axis=1), out=low)
    return low


def fewest_matches(n: int, share: float, miss: float = MISS) -> int:
    """Fewest of ``n`` equal values with which a pair may still reach ``share``.

    P(similarity >= share | m of n) under a uniform prior is P(Binomial(n + 1, share) <= m).
    """
    total, m = 0.0, -1
    while total < miss:
        m += 1
        total += comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
    return m


def plausible(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential test."""
    alive = np.arange(len(a))
    same = np.zeros(len(a), np.int64)
    for n in range(STEP, a.shape[1] + 1, STEP):
        same[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1)
        alive = alive[same[alive] >= fewest_matches(n, share)]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, x, y, sig) of documents (id, text): set size, key of the set, signature (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, y, sig = [], [], [], []
            for part in slices(batch.column(1)):
                for s in shingle_sets(part, k):
                    n.append(len(s))
                    x.append(int(mix64(s).sum(dtype=np.uint64).astype(np.int64)))
                    y.append(int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                    sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(sig, pa.binary())],
                ["id", "n", "x", "y", "sig"],
            )

    return docs.mapInArrow(run, "id long, n long, x long, y long, sig binary")


def banded(signatures: DataFrame) -> DataFrame:
    """(block, id, size): one row for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.uint64(0xFF51AFD7ED558CCD)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(2)).astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for j in range(ROWS):
                key = mix64(key * step + sig[:, :, j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.astype(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.repeat(batch.column(1).to_numpy(), BANDS))],
                ["block", "id", "size"],
            )

    return signatures.select("id", "n", "sig").mapInArrow(run, "block long, id long, size long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """Components of documents whose ``k``-word shingle sets overlap by ``num / den`` or more.

    A-Z is folded. A text with fewer words than k is one shingle; null, empty and blank texts have none
    and link with nothing. Ids are integers that name a document; a row without one takes no part
    (component null, kept). Repeated rows are linked like other copies. Columns but the id and the
    text are not read. Returns the id, n_shingles, component_id (smallest id reachable) and kept.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = materialize(signed(base, k))
    # rows of one class have one set, so any row's size and signature stand for all
    one = materialize(
        sigs.where("n > 0 and id is not null").groupBy("x", "y").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    )
    bands = banded(one)
    shared = bands.groupBy("block").agg(F.count("*").alias("m"), F.min("id").alias("leader")).where("m > 1")
    members = materialize(bands.join(shared, "block"))
    ids = members.select("id").distinct()
    wanted = base.join(ids.hint("shuffle_hash"), "id", "left_semi")
    sets = materialize(_sets(wanted, k))

    def verify(pairs: DataFrame) -> DataFrame:
        s = one.select("id", "sig")
        both = pairs.join(s.toDF("a", "sig_a"), "a").join(s.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
        some = both.mapInArrow(_test(num / den), "a long, b long")
        full = some.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        return full.mapInArrow(_confirm(num, den), "a long, b long")

    def fits(a, b):
        return F.least(a, b) * den >= F.greatest(a, b) * num

    small = members.where(F.col("m") <= FEW)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, F.col("x.block") == F.col("y.block")).where((F.col("x.id") < F.col("y.id")) & fits(F.col("x.size"), F.col("y.size")))
    links = materialize(verify(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()))
    star = materialize(members.where(F.col("m") > FEW).select(F.col("id").alias("a"), F.col("leader").alias("b")))
    if star.limit(1).count():
        size = one.select("id", F.col("n").alias("size"))
        crowd = materialize(graph.contracted_components(star).withColumnRenamed("component", "crowd").join(size, "id"))
        links = materialize(links.union(verify(_led(crowd, fits))))
        components = graph.contracted_components(links)
        crowd = crowd.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = materialize(_tiled(materialize(crowd), one, sets, num, den))
        if more.limit(1).count():
            components = graph.contracted_components(links.union(more))
    else:
        components = graph.contracted_components(links)
    labelled = one.select("id", "x", "y").join(components, "id", "left").select("x", "y", F.coalesce("component", "id").alias("component"))
    out = sigs.select("id", "n", "x", "y").join(labelled, ["x", "y"], "left")
    mine = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), mine.cast("long").alias("component_id"), F.coalesce(F.col("id") == mine, F.lit(True)).alias("kept")
    )


def _led(crowd: DataFrame, fits) -> DataFrame:
    """Pairs (a, b) of each crowd's leaders with all its documents; leaders have the lowest hashes."""
    order = F.xxhash64("id")
    # a minimum of each of LEADERS hash classes: fixed buffers, summed before the shuffle
    leaders = crowd.groupBy("crowd", F.pmod(order, F.lit(LEADERS)).alias("k")).agg(F.min("id").alias("leader"))
    leaders = leaders.join(crowd.select(F.col("id").alias("leader"), F.col("size").alias("leader_size")), "leader")
    pairs = crowd.join(leaders, "crowd").where((F.col("id") != F.col("leader")) & fits(F.col("size"), F.col("leader_size")))
    return pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _tiled(crowd: DataFrame, signatures: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) across the components of each crowd (id, crowd, size, component)."""
    each = crowd.groupBy("crowd", "component").agg(F.count("*").alias("m"))
    open_ = each.groupBy("crowd").agg(F.count("*").alias("kinds")).where("kinds > 1").select("crowd")
    # a large component has chunks of its own (pool: the component), the rest of a crowd shares chunks (pool null)
    each = each.join(open_, "crowd").withColumn("pool", F.when(F.col("m") >= CHUNK, F.col("component")))
    pools = each.groupBy("crowd", "pool").agg(F.sum("m").alias("m")).withColumn("chunks", F.ceil(F.col("m") / CHUNK))
    placed = crowd.join(each.select("crowd", "component", "pool"), ["crowd", "component"])
    p = pools.select(F.col("crowd").alias("c"), F.col("pool").alias("p"), "chunks")
    placed = placed.join(p, (F.col("crowd") == F.col("c")) & F.col("pool").eqNullSafe(F.col("p")))
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks"))
    placed = placed.select("id", "component", "crowd", "pool", F.xxhash64("crowd", "pool", part).alias("chunk"))
    data = placed.join(signatures.select("id", "n", "sig"), "id").join(sets, "id")
    packed = materialize(
        data.groupBy("chunk").agg(
            F.min("crowd").alias("crowd"), F.min("pool").alias("pool"),
            F.collect_list(F.struct("id", "component", "n", "sig", "shingles")).alias("rows"),
        )
    )
    x, y = (packed.select("crowd", "pool", "chunk").alias(k) for k in "xy")
    tiles = x.join(y, F.col("x.crowd") == F.col("y.crowd")).where(
        (F.col("x.chunk") <= F.col("y.chunk")) & ~F.coalesce(F.col("x.pool") == F.col("y.pool"), F.lit(False))
    )
    tiles = tiles.select(F.col("x.chunk").alias("first"), F.col("y.chunk").alias("second"))
    left = packed.select(F.col("chunk").alias("first"), F.col("rows").alias("left"))
    right = packed.select(F.col("chunk").alias("second"), F.col("rows").alias("right"))
    both = tiles.join(left, "first").join(right, "second").select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = tile_links(*(batch.column(c).slice(i, 1).flatten() for c in (0, 1)), num, den)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)] if found else [pa.array([], pa.int64())] * 2, ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def tile_links(left: pa.StructArray, right: pa.StructArray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between two chunks (or within one), enough to connect all that link across components."""
    (ia, ca, na, sa, ga), (ib, cb, nb, sb, gb) = ([x.field(k) for k in range(5)] for x in (left, right))
    ia, ca, na, ib, cb, nb = (v.to_numpy(zero_copy_only=False) for v in (ia, ca, na, ib, cb, nb))
    may = (ca[:, None] != cb) & (np.minimum(na[:, None], nb) * den >= np.maximum(na[:, None], nb) * num)
    if len(ia) == len(ib) and (ia == ib).all():
        may = np.triu(may, 1)
    i, j = np.nonzero(may)
    sa, sb = _matrix(sa), _matrix(sb)
    keep = np.concatenate([plausible(sa[i[k : k + 65536]], sb[j[k : k + 65536]], num / den) for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    i, j = i[keep], j[keep]
    alike = np.array([(sa[x] == sb[y]).sum() for x, y in zip(i, j)])
    order = np.argsort(-alike, kind="stable")
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    shingles: dict[tuple, frozenset] = {}

    def of(side: int, k: int) -> frozenset:
        if (side, k) not in shingles:
            shingles[side, k] = frozenset(np.frombuffer((ga, gb)[side][k].as_py(), np.uint64).tolist())
        return shingles[side, k]

    found = []
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        u, v = find(int(ca[x])), find(int(cb[y]))
        if u == v:
            continue
        p, q = of(0, x), of(1, y)
        common = len(p & q)
        if den * common >= num * (len(p) + len(q) - common):
            root[max(u, v)] = min(u, v)
            found.append((int(ia[x]), int(ib[y])))
    return found


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for part in slices(batch.column(1)) for s in shingle_sets(part, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def _test(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = plausible(_matrix(batch.column(2)), _matrix(batch.column(3)), share)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run
