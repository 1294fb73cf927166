"""Command line: run the reference workload and write the report tables.

    python -m precursor --intervals PATH|TABLE --jobs PATH|TABLE --start-date 2024-11-11 \
        [--span-days 15] [--job-match 4.18 --job-match azure] [--job-exclude single-node] \
        [--lookback-seconds 40] [--lookahead-seconds 1] [--top-k 25] --out PATH

Run it with ``spark-submit -m``-style launchers or plain ``python`` (a local
session is created when none is configured).  Prints the per-target summary.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from precursor.plans import report
from precursor.plans.config import REFERENCE_JOB_EXCLUDES, REFERENCE_JOB_INCLUDES, reference_config
from precursor.plans.analysis import Analysis
from precursor.session import apply_recommended_conf
from precursor.sources.intervals import read_intervals, read_jobs


def parse_args(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="precursor", description=__doc__.split("\n\n")[0])
    p.add_argument("--intervals", required=True, help="parquet path or table of native intervals")
    p.add_argument("--jobs", required=True, help="parquet path or table of job runs")
    p.add_argument("--start-date", required=True, help="first day of the range, e.g. 2024-11-11")
    p.add_argument("--span-days", type=int, default=15)
    p.add_argument("--job-match", action="append", help="substring every job name must contain (repeatable)")
    p.add_argument("--job-exclude", action="append", help="substring no job name may contain (repeatable)")
    p.add_argument("--lookback-seconds", type=float, default=40.0)
    p.add_argument("--lookahead-seconds", type=float, default=1.0)
    p.add_argument("--top-k", type=int, default=25)
    p.add_argument("--out", required=True, help="folder for the report tables")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parse_args(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("precursor").getOrCreate()
    apply_recommended_conf(spark)
    cfg = reference_config(args.start_date, args.span_days)
    cfg.job_includes = tuple(args.job_match) if args.job_match else REFERENCE_JOB_INCLUDES
    cfg.job_excludes = tuple(args.job_exclude) if args.job_exclude else REFERENCE_JOB_EXCLUDES
    cfg.lookback = dt.timedelta(seconds=args.lookback_seconds)
    cfg.lookahead = dt.timedelta(seconds=args.lookahead_seconds)
    cfg.k = args.top_k
    a = Analysis(spark, read_intervals(spark, args.intervals), read_jobs(spark, args.jobs), cfg)
    paths = report.write_report(a, args.out)
    spark.read.parquet(paths["target_summary"]).orderBy("target_id").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
