"""python -m sonolith QUERY SF_DIR [--out FOLDER] [--rows N]: run a registered query."""

from __future__ import annotations

import argparse

from sonolith import plans
from sonolith.session import build_session


def main(argv: list[str] | None = None) -> int:
    queries, _ = plans.load()
    p = argparse.ArgumentParser(prog="sonolith", description="Run a registered query over a folder of Parquet tables.")
    p.add_argument("query", choices=sorted(queries), metavar="QUERY")
    p.add_argument("sf_dir")
    p.add_argument("--out", help="folder for the result as Parquet")
    p.add_argument("--rows", type=int, default=20, help="rows to show without --out")
    p.add_argument("--master")
    a = p.parse_args(argv)
    spark = build_session(a.query, a.master)
    df = queries[a.query](spark, a.sf_dir)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
