"""The command line runs the reference workload end to end."""

from __future__ import annotations

import golden

from precursor.__main__ import main
from precursor.schema import INTERVALS_SCHEMA, JOBS_SCHEMA


def test_cli_writes_report(spark, tmp_path):
    rows, jobs = golden.build()
    iv, jb = str(tmp_path / "iv"), str(tmp_path / "jobs")
    spark.createDataFrame([tuple(r[f.name] for f in INTERVALS_SCHEMA) for r in rows], INTERVALS_SCHEMA).write.parquet(iv)
    spark.createDataFrame([tuple(j[f.name] for f in JOBS_SCHEMA) for j in jobs], JOBS_SCHEMA).write.parquet(jb)
    out = str(tmp_path / "out")
    assert main(["--intervals", iv, "--jobs", jb, "--start-date", "2024-11-11", "--out", out], spark) == 0
    summary = {r["target_id"]: r for r in spark.read.parquet(f"{out}/target_summary").collect()}
    assert len(summary) == 8 and summary[1]["n_anchors"] == 2 and summary[1]["n_patterns"] > 0
    assert spark.read.parquet(f"{out}/patterns").count() > 0
    assert spark.read.text(f"{out}/report_nested").count() > 0
