"""python -m tessella [-c CONFIG] [-f binary|csv] [-v] INPUT DIMENSIONS OUTPUT"""

from __future__ import annotations

import argparse
import time

from tessella.config import load_config
from tessella.operators.layout import coordinates
from tessella.plans.reducer import Reducer
from tessella.session import get_session
from tessella.sources.matrix import read_matrix, write_csv, write_matrix


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description="Map the rows of a binary matrix to a few coordinates.")
    parser.add_argument("input", help="int32 rows, int32 columns, then float32 row by row")
    parser.add_argument("dimensions", type=int)
    parser.add_argument("output")
    parser.add_argument("-c", "--config", help="JSON settings")
    parser.add_argument("-f", "--format", choices=("binary", "csv"), default="binary", help="form of the output")
    parser.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(argv)
    spark = get_session()
    config = load_config(args.config)
    if args.verbose:
        print(config)
    began = time.time()
    out = Reducer(config).reduce(read_matrix(spark, args.input), args.dimensions, "id", "x").cache()
    n = out.count()
    print(f"{n} rows in {time.time() - began:.3f} s")
    (write_csv if args.format == "csv" else write_matrix)(out, coordinates(args.dimensions), args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
