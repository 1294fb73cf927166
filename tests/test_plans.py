"""Plan shape: what the physical plans must and must not contain."""

from __future__ import annotations

import pytest

from precursor.operators import evidence as EV
from precursor.operators import sequences as SQ
from precursor.plans.config import adapter_config
from precursor.plans.analysis import Analysis
from precursor.sources.adapter import read_adapted

SF = "/root/testdata/sf0.001"
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def a(spark):
    iv, jobs = read_adapted(spark, SF)
    return Analysis(spark, iv, jobs, adapter_config())


def stage_plans(a):
    return {
        "anchors": a.anchors, "context": a.context_plan(),
        "events": SQ.token_events(a.context), "sequences": SQ.build_sequences(a.events),
        "support": EV.pattern_support(a.sequences, a.patterns),
        "window_rows": a.window_rows, "examples": a.examples,
    }


def test_no_cartesian_no_python(a):
    for name, df in stage_plans(a).items():
        p = plan(df)
        for bad in BAD:
            assert bad not in p, (name, bad)


def test_date_range_pushed_to_scan(a, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    c = a.context_plan()
    p = plan(c)
    text = c._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(from_time,2024-01-03T00:00)" in text
    assert "LessThanOrEqual(from_time,2024-01-29T00:00)" in text
    assert "BroadcastHashJoin" in p or "SortMergeJoin" in p


def test_json_parsed_once(a):
    # after the flat table is materialised, no stage parses JSON again on the hot path
    for name in ("anchors", "context", "events", "sequences"):
        p = plan(stage_plans(a)[name]).lower()
        assert "from_json" not in p and "parse_json" not in p and "get_json_object" not in p, name


def test_payload_not_read_by_hot_scans(a, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    for name in ("anchors", "context"):
        text = stage_plans(a)[name]._jdf.queryExecution().toString()
        scan_schemas = [line for line in text.splitlines() if "ReadSchema" in line or "ReadSchema:" in line]
        assert all("payload:" not in s for s in scan_schemas), name


def test_first_anchor_uses_group_limit(a):
    from precursor.operators import anchors as AN
    c = a.cfg
    df = AN.find_anchors(a.flat, a.jobs, c.targets, c.start, c.end, c.job_includes, c.job_excludes, c.excluded_origin)
    assert "WindowGroupLimit" in plan(df)


def test_window_join_without_broadcast_is_keyed_by_run_and_time(a, spark):
    rows = lambda df: sorted(map(tuple, df.select("target_id", "job_id", "e_event_id", "e_diff").collect()))
    expected = rows(a.context_plan())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = a.context_plan()
        p = plan(df)
        assert any("SortMergeJoin [job_id" in x and "_b#" in x for x in p.splitlines())
        assert rows(df) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_events_stage_hash_aggregates_and_reads_one_name_map(a):
    p = plan(SQ.token_events(a.context, mappings=a.name_map))
    assert "SortAggregate" not in p                      # run key is a long: hash aggregation
    assert "Generate inline" not in p                    # the name mapping is read, not re-planned


def test_topk_windows_use_group_limit(a):
    from precursor.operators import mining as MN
    assert "WindowGroupLimit" in plan(MN.start_thresholds(a.sequences, 25))
    freq = MN.frequent_sequences_by_key(a.sequences, 2)
    assert "WindowGroupLimit" in plan(MN.topk_patterns(freq, 25))


def test_hot_run_is_spread_over_partitions(spark):
    """One run holding a third of all rows: the sort-merge window join splits it by time bucket."""
    from pyspark.sql import functions as F

    from precursor.sources.adapter import intervals_from_events, jobs_from_customer
    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet")
    # run 3 passes the job filter (start within the range, not FURNITURE)
    events = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(3)).otherwise(F.col("user_id")))
    hot = Analysis(spark, intervals_from_events(events), jobs_from_customer(spark.read.parquet(f"{sf}/customer.parquet")),
                   adapter_config())
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ctx = hot.context_plan().where(F.col("job_id") == "3")
        parts = ctx.select(F.spark_partition_id().alias("p")).distinct().count()
        assert ctx.count() > 0 and parts > 1
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_mining_moves_states_not_sequences(spark):
    """M3: a level joins its states to the bucketed sequences, which stay where they are; shuffle keys are numbers."""
    import re

    from precursor.operators import closed as C

    rows = [(0, r, [1, 2, r % 3 + 3, 9]) for r in range(60)]
    seqs, name = C.stored_sequences(spark.createDataFrame(rows, "target_id int, run long, seq array<bigint>"))
    states = seqs.selectExpr("CAST(target_id AS bigint) AS prefix", "target_id", "60L AS support", "run", "0 AS place")
    prefixes = spark.createDataFrame([(0, 0, [], 60)], "prefix long, target_id int, pattern array<bigint>, support long")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = C._counts(states, prefixes, seqs)
        p = plan(counts)
        scans = [x for x in p.splitlines() if "FileScan" in x and "seq#" in x]
        assert scans and all("Bucketed: true" in x for x in scans)
        assert not re.search(r"Exchange hashpartitioning\(run", p)  # the states come from the same buckets here
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
        assert keys and not any("pattern" in k or "seq" in k for k in keys)
        moved = spark.createDataFrame([(0, 0, 60, r, 0) for r in range(60)], "prefix long, target_id int, support long, run long, place int")
        p = plan(C._counts(moved, prefixes, seqs))
        assert len(re.findall(r"Exchange hashpartitioning\(run", p)) == 1
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_window_join_is_narrow_and_filtered_by_runs(a, spark):
    """Rows of runs without an anchor are dropped where they are scanned, and the join moves narrow anchors."""
    import re

    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        p = plan(a.context_plan())
        lines = p.splitlines()
        join = next(i for i, x in enumerate(lines) if "SortMergeJoin [job_id" in x and "_b#" in x)
        assert any("BroadcastHashJoin" in x and "LeftSemi" in x for x in lines[join:])  # the run filter, under the join
        scans = [re.search(r"ReadSchema: struct<(.*)", x)[1] for x in p.splitlines() if "d_from_time" in x and "ReadSchema" in x]
        narrow = [s for s in scans if "job_url" not in s and "d_message" not in s and "d_from_time" in s]
        assert narrow  # the side that meets the intervals; the other scan attaches the rest afterwards
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
