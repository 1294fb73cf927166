"""The flat table by day, ordered tables, payloads fetched late, generated ids."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from precursor.functions.criteria import Field, FieldLike, Target
from precursor.operators.payloads import with_payload
from precursor.plans.analysis import Analysis, flat_store
from precursor.plans.config import AnalysisConfig
from precursor.sources.flat import missing_days
from precursor.sources.intervals import read_intervals
from precursor.sources.ordered import read_ordered, write_ordered

START = dt.datetime(2024, 1, 1)


def _payload(i):
    return json.dumps({"source": f"s{i % 3}", "display": "true", "message": {"reason": "x" if i % 2 else "y", "humanMessage": f"m{i}"},
                       "locator": {"keys": {}}})


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Twenty days of intervals in one file per day, a row without a time, one without a payload."""
    path = str(tmp_path_factory.mktemp("raw") / "intervals")
    rows = [(str(i % 4), i, START + dt.timedelta(days=i % 20, hours=i % 24), "collector", _payload(i)) for i in range(400)]
    rows += [("0", 1000, None, "collector", _payload(1)), ("0", 1001, START, "collector", None)]
    spark.createDataFrame(rows, "job_id string, event_id long, from_time timestamp_ntz, origin string, interval string").selectExpr(
        "job_id", "event_id", "from_time", "from_time + interval 1 second AS to_time", "origin", "interval",
        "CAST(NULL AS string) AS interval_json").repartitionByRange(20, "from_time").write.parquet(path)
    return path


def _text(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(autouse=True)
def _long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")


def test_missing_days():
    d = lambda n: dt.date(2024, 1, n)
    assert missing_days((d(3), d(9)), []) == [(d(3), d(9))]
    assert missing_days((d(3), d(9)), [(d(1), d(4)), (d(6), d(6)), (d(9), d(20))]) == [(d(5), d(5)), (d(7), d(8))]
    assert missing_days((d(3), d(9)), [(d(5), d(6)), (d(1), d(31))]) == []
    assert missing_days((d(3), d(9)), [(d(10), d(12))]) == [(d(3), d(9))]


def test_only_missing_days_are_parsed(spark, raw):
    store = flat_store(read_intervals(spark, raw), "only-missing")
    got = store.days("2024-01-05 00:00:00", "2024-01-07 12:00:00")
    assert got.select(F.min("day"), F.max("day"), F.count("*")).first()[:] == (dt.date(2024, 1, 5), dt.date(2024, 1, 7), 60)
    files = set(store.days("2024-01-06 00:00:00", "2024-01-06 01:00:00").inputFiles())
    again = store.days("2024-01-04 00:00:00", "2024-01-08 00:00:00")
    assert again.count() == 100 and files <= set(store._read().inputFiles())  # the days of before stay as they are
    assert sorted(store.finished()[0]) == [(dt.date(2024, 1, 4), dt.date(2024, 1, 4)), (dt.date(2024, 1, 5), dt.date(2024, 1, 7)),
                                           (dt.date(2024, 1, 8), dt.date(2024, 1, 8))]
    assert store.all().count() == 402 and store.finished()[1]
    assert files <= set(store._read().inputFiles())
    assert store.all().where("from_time IS NULL").count() == 1
    assert store.all().select("event_id").distinct().count() == 402


def test_a_failed_day_is_written_again(spark, raw):
    store = flat_store(read_intervals(spark, raw), "failed-day")
    broken = store.intervals.where("event_id % 20 = 2")  # a job that died after some files of the third day
    store._write(broken, [])
    assert store.finished() == ([], False)
    assert store.days("2024-01-03 00:00:00", "2024-01-03 00:00:00").count() == 20


def test_range_reaches_both_scans(spark, raw):
    from precursor.functions.payload import flatten_intervals
    from precursor.sources.flat import raw_rows

    days = [(dt.date(2024, 1, 5), dt.date(2024, 1, 7))]
    text = _text(flatten_intervals(raw_rows(read_intervals(spark, raw), days)))
    scan = text[text.index("== Physical Plan"):]
    assert "GreaterThanOrEqual(from_time,2024-01-05T00:00)" in scan and "LessThan(from_time,2024-01-08T00:00)" in scan
    flat = flat_store(read_intervals(spark, raw), "both-scans").days("2024-01-05 00:00:00", "2024-01-07 00:00:00")
    text = _text(flat.select("event_id"))
    assert "PartitionFilters: [isnotnull(day" in text and "day" in text.split("PartitionFilters")[1][:120]


def _analysis(spark, raw):
    jobs = spark.createDataFrame([(str(i), "job", "u", dt.datetime(2024, 1, 2)) for i in range(4)],
                                 "job_id string, job_name string, job_url string, job_start timestamp_ntz")
    cfg = AnalysisConfig([Target([FieldLike(Field.SOURCE, "s1")]), Target([FieldLike(Field.SOURCE, "s2")])],
                         "2024-01-02 00:00:00", "2024-01-15 00:00:00", dt.timedelta(days=2), dt.timedelta(hours=6))
    return Analysis(spark, read_intervals(spark, raw), jobs, cfg)


def test_payloads_of_the_right_rows(spark, raw):
    a = _analysis(spark, raw)
    anchors, context = a.anchors_full.collect(), a.context_full.collect()
    assert len(anchors) == a.anchors.count() > 0 and len(context) == a.context.count() > 0
    for r in anchors:
        assert r["row_num"] == 1 and json.loads(r["d_payload"]) == json.loads(_payload(r["d_event_id"]))
    for r in context:
        assert json.loads(r["e_payload"]) == json.loads(_payload(r["e_event_id"]))
        assert json.loads(r["d_payload"]) == json.loads(_payload(r["d_event_id"])) and r["row_num"] == 1
    assert "day=2024-01-20" not in " ".join(a.flat_in_range.inputFiles())  # nothing out of reach was parsed


def test_payload_edges(spark, raw):
    flat = flat_store(read_intervals(spark, raw), "edges").all()
    rows = spark.createDataFrame([("0", 1001, START), ("0", None, START), ("9", 4, START), (None, 0, START), ("0", 0, START), ("0", 0, START),
                                  ("0", 0, None)], "job_id string, id long, at timestamp_ntz")
    got = sorted(((r["job_id"], r["id"], r["p"] and json.loads(r["p"])["message"]["humanMessage"]) for r in
                  with_payload(rows, flat, "id", "at", "p").collect()), key=str)
    assert got == sorted([("0", 1001, None), ("0", None, None), ("9", 4, None), (None, 0, None), ("0", 0, "m0"), ("0", 0, "m0"),
                          ("0", 0, None)], key=str)
    assert with_payload(rows.where("false"), flat, "id", "at", "p").count() == 0


def test_ordered_table(spark, tmp_path):
    df = spark.range(5000).selectExpr("id % 3 AS run", "CAST(hash(id) % 50 AS int) AS at", "id").repartition(6)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = write_ordered(df, f"{tmp_path}/o", "run", "at", "id")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    rows = read_ordered(spark, path).collect()
    assert sorted(r["ordinal"] for r in rows) == list(range(5000))
    rows.sort(key=lambda r: r["ordinal"])
    assert [(r["run"], r["at"], r["id"]) for r in rows] == sorted((r["run"], r["at"], r["id"]) for r in rows)
    assert spark.read.parquet(path).select("_part").distinct().count() > 1  # order is kept across files
    assert read_ordered(spark, write_ordered(df.where("false"), f"{tmp_path}/none", "run")).count() == 0


def test_context_is_written_in_order(spark, raw, tmp_path):
    rows = _analysis(spark, raw).write_context(f"{tmp_path}/context").orderBy("ordinal").collect()
    keys = [(r["target_id"], r["job_id"], r["e_from_time"], r["e_event_id"]) for r in rows]
    assert keys == sorted(keys) and len(rows) > 0


def _no_ids(spark, tmp_path, n, copies):
    path = f"{tmp_path}/noid"
    rows = spark.range(n).selectExpr(
        "CAST(id % 5 AS string) AS job_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 20 AS int)) AS from_time",
        "timestamp_ntz'2024-01-05 00:00:01' AS to_time", "'collector' AS origin", "CAST(id AS string) AS interval",
        "CAST(NULL AS string) AS interval_json")
    for _ in range(copies):
        rows = rows.unionByName(rows.where("interval < '1'"))
    rows.write.parquet(path)
    return path


def test_generated_ids_are_unique(spark, tmp_path):
    df = read_intervals(spark, _no_ids(spark, tmp_path, 300, 3))
    n = df.count()
    assert n > 300 and df.select("event_id").distinct().count() == n


def test_generated_ids_do_not_shuffle_payloads(spark, tmp_path):
    df = read_intervals(spark, _no_ids(spark, tmp_path, 300, 0)).where("from_time > timestamp_ntz'2024-01-15 00:00:00'")
    text = _text(df)
    physical = text[text.index("== Physical Plan"):]
    scans = [x for x in physical.splitlines() if "FileScan" in x and "interval" in x]
    assert scans and all("GreaterThan(from_time,2024-01-15T00:00)" in x for x in scans)
    # rows that do not repeat come without any exchange; an exchange is fed by the rows that may repeat alone
    moved = [x for x in physical.splitlines() if "Exchange hashpartitioning(_same" in x]
    single = physical.split("Union", 1)[1].split("Window", 1)[0]
    assert moved and not any(x in single for x in moved)
