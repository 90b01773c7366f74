"""Nearest neighbours by a block matrix join with quantisation error bounds.

Vectors are packed into tiles: int8 codes with a scale and an error norm for each vector, next to the
floats. Every block of queries meets every tile of candidates; one int8 matrix product gives rough
distances, and the error norms bound how far they can be off. Pairs whose lower bound is within the
k-th smallest upper bound are computed again in double precision; heaps of k merge the tiles.
The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.text import mix64

TILE = 4096
BLOCK = 512
#: Query blocks whose heaps a task holds at a time.
HELD = 32

_PACKED = "dim int, ids binary, vectors binary, codes binary, scales binary, errors binary, n int"


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector that is finite, not null, not empty and not zero."""
    v = F.col(vector_col)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")
    )


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each row, and the norm of each row's error."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return codes, scale, error


def pack(size: int):
    """Pack rows (id, v) of each task into tiles of ``size`` vectors of one length."""

    def tile(ids: list, parts: list) -> pa.RecordBatch:
        x = np.concatenate(parts)
        codes, scale, error = quantise(x)
        i = np.concatenate(ids)
        row = [x.shape[1], i.tobytes(), x.tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes(), len(i)]
        kinds = [pa.int32()] + [pa.binary()] * 5 + [pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = flat[offsets[:-1][at][:, None] + np.arange(dim)]
                i = ids[at]
                keep = held.setdefault(dim, ([], []))
                while len(i):
                    room = size - sum(map(len, keep[0]))
                    keep[0].append(i[:room])
                    keep[1].append(x[:room])
                    i, x = i[room:], x[room:]
                    if sum(map(len, keep[0])) == size:
                        yield tile(*keep)
                        keep = held[dim] = ([], [])
        for keep in held.values():
            if keep[0]:
                yield tile(*keep)

    return run


def _unpack(row: dict, prefix: str) -> dict:
    n, dim = row[f"{prefix}_n"], row["dim"]
    take = lambda c, t: np.frombuffer(row[f"{prefix}_{c}"], t)
    return {
        "ids": take("ids", np.int64), "x": take("vectors", np.float64).reshape(n, dim),
        "codes": take("codes", np.int8).reshape(n, dim).astype(np.float32), "scales": take("scales", np.float64), "errors": take("errors", np.float64),
    }


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs, summed from the first component to the last in double precision."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += (q[:, j] - c[:, j]) ** 2
    return np.sqrt(total)


def tile_nearest(q: dict, c: dict, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate id, distance) of all pairs that can be among a query's k nearest here.

    ``bound`` holds each query's k-th distance so far, infinite where there are fewer.
    """
    hat_q = ((q["codes"].astype(np.float64) * q["scales"][:, None]) ** 2).sum(axis=1)
    hat_c = ((c["codes"].astype(np.float64) * c["scales"][:, None]) ** 2).sum(axis=1)
    # sums of products of int8 fit float32 without rounding up to 2**24 / 127**2 components
    product = (q["codes"] @ c["codes"].T).astype(np.float64) if q["x"].shape[1] <= 1040 else q["codes"].astype(np.float64) @ c["codes"].T.astype(np.float64)
    product *= q["scales"][:, None]
    product *= c["scales"]
    rough = np.sqrt(np.maximum(hat_q[:, None] + hat_c - 2 * product, 0))
    # rounding of the subtraction, relative to the norms
    slack = 1e-6 * np.sqrt(hat_q[:, None] + hat_c)
    off = q["errors"][:, None] + c["errors"] + slack
    own = q["ids"][:, None] == c["ids"]
    upper = np.where(own, np.inf, rough + off)
    if upper.shape[1] > k:
        bound = np.minimum(bound, np.partition(upper, k - 1, axis=1)[:, k - 1])
    a, b = np.nonzero((rough - off <= bound[:, None]) & ~own)
    found = np.concatenate([exact(q["x"][a[i : i + 65536]], c["x"][b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    return a, c["ids"][b], found


def vector_keys(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's components."""
    bits = np.ascontiguousarray(x).view(np.uint64) + np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(mix64(bits).sum(axis=1, dtype=np.uint64)).view(np.int64)


def best(place: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each query by score, then id."""
    order = np.lexsort((ids, score, place))
    p = place[order]
    first = np.searchsorted(p, p, "left")
    return order[np.arange(len(p)) - first < k]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of ``vectors`` for each row of ``queries``: query_id, rank, vec_id, score.

    Smallest Euclidean distance first, ties to the smaller id; rows with the query's id are its own
    and never found. Rows without an id and vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of another length than the query's are not candidates.
    Repeated rows of ``vectors`` count each. Repeated rows of ``queries`` are one query; rows of one id with other
    vectors are queries of their own, each with a list under that id. Fewer candidates than k give
    fewer rows; empty tables give none.
    Query blocks meet all tiles through a join on a slot number: candidates are dealt once over the
    slots, and only the far fewer query blocks are repeated for each slot.
    """
    spark = vectors.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tiles = valid(vectors, id_col, vector_col).mapInArrow(pack(TILE), _PACKED)
    blocks = valid(queries, id_col, vector_col).dropDuplicates(["id", "v"]).mapInArrow(pack(BLOCK), _PACKED)
    names = [c.split()[0] for c in _PACKED.split(", ")][1:]
    tiles = tiles.select("dim", F.pmod(F.xxhash64("ids"), F.lit(slots)).alias("slot"), *[F.col(c).alias(f"c_{c}") for c in names])
    blocks = blocks.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"), *[F.col(c).alias(f"q_{c}") for c in names])
    pairs = tiles.join(blocks.hint("shuffle_hash"), ["slot", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple] = {}

        def out() -> pa.RecordBatch:
            q = [np.concatenate(x) for x in zip(*((ids[p], own[p], i, s) for (ids, own), p, i, s in held.values()))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in q], ["query_id", "own", "vec_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q, c = _unpack(row, "q"), _unpack(row, "c")
                key = row["q_ids"], row["q_vectors"]
                who, p, i, s = held.get(key) or ((q["ids"], vector_keys(q["x"])), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                bound = np.full(len(q["ids"]), np.inf)
                if len(p):
                    last = np.append(p[1:] != p[:-1], True)
                    full = np.bincount(p, minlength=len(bound)) >= k
                    bound[p[last]] = s[last]
                    bound[~full] = np.inf
                a, b, d = tile_nearest(q, c, k, bound)
                p, i, s = np.concatenate([p, a]), np.concatenate([i, b]), np.concatenate([s, d])
                keep = best(p, i, s, k)
                held[key] = who, p[keep], i[keep], s[keep]
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    found = pairs.mapInArrow(run, "query_id long, own long, vec_id long, score double")
    order = Window.partitionBy("query_id", "own").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
