"""Cache keys see every file and every parameter; generated ids don't depend on the layout."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from precursor.functions.criteria import Field, FieldLike, Target
from precursor.plans.analysis import Analysis
from precursor.plans.config import AnalysisConfig
from precursor.sources.cache import snapshot, snapshot_id
from precursor.sources.intervals import read_intervals


def test_a_rewritten_file_changes_the_key_of_a_large_table(spark, tmp_path):
    for i in range(1001):
        (tmp_path / f"f{i}.csv").write_text(f"{i}\n")
    read = lambda: spark.read.schema("a string").csv(str(tmp_path))
    before = snapshot_id(read())
    assert snapshot_id(read()) == before
    (tmp_path / "f500.csv").write_text("other\n")
    changed = snapshot_id(read())
    assert changed != before
    stat = os.stat(tmp_path / "f7.csv")
    (tmp_path / "f7.csv").write_text("8\n")  # same size
    os.utime(tmp_path / "f7.csv", (stat.st_atime, stat.st_mtime + 5))
    assert snapshot_id(read()) != changed


def test_data_without_files_is_never_identified(spark):
    df = spark.range(3)
    assert snapshot_id(df) is None
    assert snapshot(df) != snapshot(df)


def _tables(spark, folder):
    def payload(reason):
        return json.dumps({"source": "s", "display": "true", "message": {"reason": reason}, "locator": {"keys": {}}})

    spark.createDataFrame(
        [(str(i), i, payload(r)) for i, r in enumerate(["x", "y", None, "z", None])], "job_id string, event_id long, interval string"
    ).selectExpr("job_id", "event_id", "timestamp_ntz'2024-01-05 00:00:00' AS from_time",
                 "timestamp_ntz'2024-01-05 00:00:01' AS to_time", "'collector' AS origin", "interval",
                 "CAST(NULL AS string) AS interval_json").write.parquet(f"{folder}/intervals")
    spark.range(5).selectExpr("CAST(id AS string) AS job_id", "'job' AS job_name", "'u' AS job_url",
                              "timestamp_ntz'2024-01-04 00:00:00' AS job_start").write.parquet(f"{folder}/jobs")


def test_configs_that_differ_in_one_field_have_their_own_results(spark, tmp_path):
    _tables(spark, tmp_path)

    def anchors(if_null):
        cfg = AnalysisConfig([Target([FieldLike(Field.REASON, "x", op="!=", if_null=if_null)])],
                             "2024-01-01 00:00:00", "2024-01-31 00:00:00")
        a = Analysis(spark, spark.read.parquet(f"{tmp_path}/intervals"), spark.read.parquet(f"{tmp_path}/jobs"), cfg)
        return a.anchors.count()

    assert (anchors(None), anchors("")) == (2, 4)


def test_flat_table_is_kept_when_only_the_jobs_change(spark, tmp_path):
    _tables(spark, tmp_path)
    cfg = AnalysisConfig([Target([FieldLike(Field.REASON, "x")])], "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    make = lambda: Analysis(spark, spark.read.parquet(f"{tmp_path}/intervals"), spark.read.parquet(f"{tmp_path}/jobs"), cfg)
    one = make()
    files = one.flat.inputFiles()
    spark.read.parquet(f"{tmp_path}/jobs").limit(1).write.mode("append").parquet(f"{tmp_path}/jobs")
    two = make()
    assert two.flat.inputFiles() == files and two.snapshot != one.snapshot


def test_generated_ids_do_not_depend_on_the_layout(spark, tmp_path):
    spark.range(200).selectExpr(
        "CAST(id % 5 AS string) AS job_id", "timestamp_ntz'2024-01-05 00:00:00' AS from_time",
        "timestamp_ntz'2024-01-05 00:00:01' AS to_time", "'collector' AS origin", "CAST(id AS string) AS interval",
        "CAST(NULL AS string) AS interval_json").coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.read.parquet(f"{tmp_path}/one").repartition(7).write.parquet(f"{tmp_path}/seven")

    def first_rows(path, size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = read_intervals(spark, path)
            return sorted(map(tuple, df.groupBy("job_id").agg(F.min_by("interval", "event_id")).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    assert first_rows(f"{tmp_path}/one", "1k") == first_rows(f"{tmp_path}/one", "256m") == first_rows(f"{tmp_path}/seven", "1m")


def test_generated_methods_stay_compilable(spark):
    # HotSpot leaves methods of more than 8000 bytes to the interpreter
    from precursor.session import apply_recommended_conf
    apply_recommended_conf(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
