"""Run a registered query as a Spark job and write its result as parquet.

    spark-submit --py-files platewise.zip -m platewise.cli search_by_dish /data/sf1 /out/search_by_dish
    python -m platewise.cli --list

Nothing is collected: the result goes straight to the output folder.
"""

from __future__ import annotations

import argparse
import sys

from platewise.plans.queries import REGISTRY
from platewise.session import get_spark


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="platewise")
    ap.add_argument("query", nargs="?", help="registered query name")
    ap.add_argument("data_dir", nargs="?", help="folder with the input parquet tables")
    ap.add_argument("out", nargs="?", help="output folder (parquet, overwritten)")
    ap.add_argument("--list", action="store_true", help="list the registered queries")
    ap.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    args = ap.parse_args(argv)
    if args.list:
        print("\n".join(sorted(REGISTRY)))
        return 0
    if not (args.query and args.data_dir and args.out):
        ap.error("query, data_dir and out are required")
    if args.query not in REGISTRY:
        ap.error(f"unknown query {args.query!r}; see --list")
    spark = get_spark(args.master)
    REGISTRY[args.query](spark, args.data_dir).write.mode("overwrite").parquet(args.out)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
