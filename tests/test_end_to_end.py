"""End to end on hand-made native intervals (JSON payloads) with the reference preset vs brute force."""

from __future__ import annotations

import datetime as dt

import golden
import pytest
from pyspark.sql import functions as F

from precursor.plans import report
from precursor.plans.config import reference_config
from precursor.plans.analysis import Analysis
from precursor.schema import INTERVALS_SCHEMA, JOBS_SCHEMA


@pytest.fixture(scope="module")
def analysis(spark):
    rows, jobs = golden.build()
    iv = spark.createDataFrame([tuple(r[f.name] for f in INTERVALS_SCHEMA) for r in rows], INTERVALS_SCHEMA)
    jb = spark.createDataFrame([tuple(j[f.name] for f in JOBS_SCHEMA) for j in jobs], JOBS_SCHEMA)
    cfg = reference_config("2024-11-11", 15)
    a = Analysis(spark, iv, jb, cfg)
    want = golden.run(rows, jobs, dt.datetime(2024, 11, 11), dt.datetime(2024, 11, 26))
    return a, want


def test_anchors(analysis):
    a, want = analysis
    got = {(r["target_id"], r["job_id"]): r["d_event_id"] for r in a.anchors.collect()}
    assert got == want["anchors"]
    assert (0, "J7") in got and (1, "J1") in got and (2, "J2") in got and (3, "J2") in got and (4, "J2") in got
    assert not any(j in {"J3", "J5", "J9"} for _, j in got)


def test_context(analysis):
    a, want = analysis
    got = {(r["target_id"], r["job_id"], r["e_event_id"], r["e_diff"]) for r in a.context.collect()}
    assert got == want["context"]
    assert {x[3] for x in got} == {"before_d", "at_d", "after_d"}


def test_sequences(analysis):
    a, want = analysis
    got = {(r["target_id"], r["job_id"]): list(r["sequence"]) for r in a.sequences.collect()}
    assert got == want["sequences"]


def test_patterns_support_examples(analysis):
    a, want = analysis
    got = {(r["target_id"], r["rank"], tuple(r["pattern"]), r["freq"]) for r in a.patterns.collect()}
    assert got == want["patterns"]
    assert {(r["target_id"], r["rank"], r["job_id"]) for r in a.support.collect()} == want["support"]
    assert {(r["target_id"], r["rank"], r["job_id"], r["item_pos"], r["example_event_id"])
            for r in a.examples.collect()} == want["examples"]


def test_report_tables(analysis, tmp_path):
    a, _ = analysis
    summary = {r["target_id"]: r for r in report.target_summary(a).collect()}
    assert len(summary) == 8
    assert summary[7]["n_anchors"] == 1 and summary[7]["n_context_rows"] == 0     # J6 (oauth-api) has no context
    assert summary[7]["status"] == "no context"
    assert summary[6]["n_anchors"] == 0 and summary[6]["status"] == "no context"
    assert summary[0]["ignore_label"] == '[REASON LIKE "NotReady"]'
    nested = report.report_nested(a)
    first = nested.where(F.col("target_id") == 1).orderBy("rank", "job_id").first()
    assert first is not None and first["target_payload"] is not None
    out = report.write_report(a, str(tmp_path / "rep"))
    assert set(out) == {"target_summary", "patterns", "pattern_support", "pattern_examples", "window_evidence",
                        "report_nested"}
    ev = a.evidence.collect()
    assert ev and all(r["origin"] != golden.OBS for r in ev)


def test_analysis_on_prepared_flat_table(analysis, spark):
    from precursor.plans.analysis import prepare_intervals
    a, want = analysis
    flat = prepare_intervals(a.intervals)
    b = Analysis(spark, None, a.jobs_raw, a.cfg, flat=flat)
    got = {(r["target_id"], r["rank"], tuple(r["pattern"]), r["freq"]) for r in b.patterns.collect()}
    assert got == want["patterns"]
