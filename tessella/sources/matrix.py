"""Matrices in files: rows, columns, then float32 in; float64 or CSV out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task reads at a time.
SPLIT = 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_matrix(spark: SparkSession, path: str, dtype: str = "<f4", split: int = SPLIT) -> DataFrame:
    """(id, x) of a binary matrix: int32 rows, int32 columns, then the numbers row by row.

    Tasks read ranges of rows by their offsets. A file that is too short raises; bytes that follow
    the last row are left alone.
    """
    store, place = _open(path)
    with store.open_input_file(place) as f:
        n, d = (int(v) for v in np.frombuffer(f.read(8), "<i4"))
        size = f.size()
    width = np.dtype(dtype).itemsize * d
    if n < 0 or d < 1 or size < 8 + n * width:
        raise ValueError(f"{path} has {size} bytes, too few for {n} rows of {d} numbers")
    rows = max(1, split // width)
    parts = max(1, -(-n // rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                first, last = part * rows, min(n, (part + 1) * rows)
                s, p = _open(path)
                with s.open_input_file(p) as f:
                    f.seek(8 + first * width)
                    x = np.frombuffer(f.read((last - first) * width), dtype)
                ids = np.arange(first, last)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, d), pa.int32()), pa.array(x.astype(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["id", "x"])

    return spark.range(0, parts, 1, parts).mapInArrow(run, "id long, x array<double>")


def _rows(df: DataFrame, cols: list[str]) -> Iterator[np.ndarray]:
    """Rows of ``cols`` in the order of ids, a partition at a time."""
    for row in df.orderBy("id").select(*cols).toLocalIterator():
        yield np.array(row, np.float64)


def write_matrix(df: DataFrame, cols: list[str], path: str, dtype: str = "<f8") -> None:
    """Write columns of numbers as a binary matrix, rows in the order of ids, replacing a file."""
    store, place = _open(path)
    with store.open_output_stream(place) as f:
        f.write(np.array([df.count(), len(cols)], "<i4").tobytes())
        for row in _rows(df, cols):
            f.write(row.astype(dtype).tobytes())


def write_csv(df: DataFrame, cols: list[str], path: str) -> None:
    """One line a row, comma-separated, no header, rows in the order of ids."""
    store, place = _open(path)
    with store.open_output_stream(place) as f:
        for row in _rows(df, cols):
            f.write((",".join(repr(float(v)) for v in row) + "\n").encode())


def write_vectors(df: DataFrame, path: str) -> None:
    """Write (id, x) as the binary float32 input form."""
    dims = len(df.first()["x"])
    write_matrix(df.select("id", *[F.col("x")[k].alias(f"x{k}") for k in range(dims)]), [f"x{k}" for k in range(dims)], path, "<f4")
