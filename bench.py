"""Benchmark: the whole analysis (3 targets of the adapter workload) stage by stage.

Env: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Prints one JSON line.  Every stage is timed cold (a fresh scratch folder, so no
materialised stage is reused); a warm-up on sf0.01 runs first and is not counted.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from precursor.plans import report  # noqa: E402
from precursor.plans.config import adapter_config  # noqa: E402
from precursor.plans.analysis import Analysis  # noqa: E402
from precursor.session import local_session  # noqa: E402
from precursor.sources.adapter import read_adapted  # noqa: E402


def run_analysis(spark, sf_dir: str, out_dir: str) -> dict[str, float]:
    iv, jobs = read_adapted(spark, sf_dir)
    a = Analysis(spark, iv, jobs, adapter_config())
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    timed("flatten", lambda: a.flat_in_range)
    timed("anchors", lambda: a.anchors)
    timed("context", lambda: a.context)
    timed("events", lambda: a.events)
    timed("sequences", lambda: a.sequences)
    timed("mining_topk_closed", lambda: a.patterns)
    timed("drilldown", lambda: a.window_rows)
    timed("report_write", lambda: report.write_report(a, out_dir))
    return times


def mine_long_runs(spark, n_runs: int = 20, n_events: int = 40) -> float:
    """Seconds to mine runs of equal events (2 ** n_events subsequences, one closed pattern)."""
    from precursor.operators.mining import topk_closed

    rows = [(0, f"r{r}", [f"e{i}" for i in range(n_events)]) for r in range(n_runs)]
    seqs = spark.createDataFrame(rows, "target_id int, job_id string, sequence array<string>")
    t0 = time.perf_counter()
    topk_closed(seqs).collect()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="precursor-bench-"))

    # Warm-up (not timed): large enough for the JVM to compile the hot paths.
    warm_sf = os.environ.get("BENCH_WARMUP_SF_DIR", "/root/testdata/sf0.01")
    if os.path.exists(f"{warm_sf}/events.parquet"):
        run_analysis(spark, warm_sf, tempfile.mkdtemp(prefix="precursor-warm-"))

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="precursor-bench-"))
    out = tempfile.mkdtemp(prefix="precursor-report-")
    t0 = time.perf_counter()
    times = run_analysis(spark, sf_dir, out)
    total = round(time.perf_counter() - t0, 3)
    extra = {"mining_20_runs_of_40_equal_events": mine_long_runs(spark)}
    if os.path.exists(f"{warm_sf}/events.parquet"):  # the small tables again, cold folders, warm JVM
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="precursor-bench-"))
        extra["sf0.01"] = run_analysis(spark, warm_sf, tempfile.mkdtemp(prefix="precursor-report-"))
    print(json.dumps({"metric": "analysis_total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "cpus": cpus, "extra": extra}))
    spark.stop()


if __name__ == "__main__":
    main()
