"""Run stages: ``spark-submit -m failscope preprocess --base /data/run1 --source /data/logs``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from failscope.plans.stages import STAGES, run
from failscope.session import RECOMMENDED


def main() -> None:
    parser = argparse.ArgumentParser(prog="failscope")
    parser.add_argument("stages", nargs="+", choices=list(STAGES))
    parser.add_argument("--base", required=True, help="folder of the stage tables")
    parser.add_argument("--source", default="", help="raw logs or archives")
    parser.add_argument("--csv", action="store_true", help="also export the tables as CSV")
    parser.add_argument("--trees", type=int)
    parser.add_argument("--rounds", type=int)
    parser.add_argument("--depth", type=int)
    args = parser.parse_args()
    builder = SparkSession.builder.appName("failscope")
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    options = {k: v for k in ("trees", "rounds", "depth") if (v := getattr(args, k)) is not None}
    for stage in args.stages:
        print(stage, "->", ", ".join(run(spark, stage, args.base, args.source, args.csv, **options)) or "done")
    spark.stop()


if __name__ == "__main__":
    main()
