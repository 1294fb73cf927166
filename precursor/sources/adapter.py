"""Adapter: the driver's ``events`` and ``customer`` tables -> native intervals and jobs.

Each event becomes one interval of the run ``user_id`` with a JSON payload built
from ``event_type`` and ``props.k``; each customer becomes one job run.  Pure
column expressions: the adapter is a map-only stage, it never shuffles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precursor.sources.intervals import spread


def _s(c: Column) -> Column:
    return c.cast("string")


def intervals_from_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type, props) -> native interval rows."""
    base = events.select(
        "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.md5(F.col("event_id").cast("string")).alias("h"),
    )
    k, h, et, uid, eid = F.col("k"), F.col("h"), F.col("event_type"), F.col("user_id"), F.col("event_id")
    null = F.lit(None).cast("string")
    # six rows in ten are coarse: times by the hour and few different tokens, so that runs share patterns
    coarse = k % 5 < 3

    def fine(value: Column, when: Column | None = None) -> Column:
        return F.when(~coarse if when is None else ~coarse & when, value)

    backend = F.when(et == "error", F.concat(F.lit("backend-"), _s(k % 10)))
    reason = (F.when((et == "view") & (k % 10 == 0), null)
              .when((et == "signup") & (k < 30), F.lit("Ended"))
              .when(et == "error", F.lit("Began"))
              .otherwise(et))
    namespace = F.when(coarse, F.lit("platform")).when(k % 3 != 0, F.concat(F.lit("ns-"), _s(uid % 20), F.lit("-"), _s(k % 10)))
    ns = fine(F.concat(F.lit("ns-"), _s(k % 10)), k % 3 == 0)
    node = fine(F.concat(F.lit("ip-10-0-"), _s(k)), k % 4 != 0)
    pod = fine(F.concat(et, F.lit("-"), _s(k % 10), F.lit("-u"), _s(uid % 75), F.lit("-"),
                        F.substring(h, 1, 10), F.lit("-"), F.substring(h, 11, 5)), et != "signup")
    letters = F.concat(F.char(97 + uid % 26), F.char(97 + eid % 26), F.char(97 + k % 26))
    message = (F.when(coarse, F.lit("state changed")).when(k % 7 == 0, null)
               .when(k % 7 < 3, F.concat(F.lit("took "), _s(k), F.lit("ms ref "), F.substring(h, 1, 12)))
               .when(k % 7 < 5, F.concat(F.lit("user "), _s(uid), F.lit(" code-"), et))
               .otherwise(F.concat(et, F.lit(" by u"), letters)))
    error = et == "error"
    keys = F.struct(
        namespace.alias("namespace"), ns.alias("ns"), F.when(error, F.concat(F.lit("dis-"), _s(k % 4))).alias("disruption"),
        F.when(error & (k % 2 == 0), F.concat(F.lit("route-"), _s(k % 3))).alias("route"),
        F.when(error & (k % 2 == 1), F.lit("new")).alias("connection"), backend.alias("backend-disruption-name"),
        node.alias("node"), pod.alias("pod"), fine(F.concat(F.lit("c"), _s(k % 3)), k % 11 == 0).alias("container"),
        fine(F.substring(h, 1, 8), k % 11 == 3).alias("uid"), fine(_s(k), k % 11 == 4).alias("row"))
    message_part = F.struct(
        reason.alias("reason"), fine(F.concat(F.lit("cause-"), _s(k % 3)), k % 13 == 3).alias("cause"),
        message.alias("humanMessage"), F.when(k % 9 == 4, k).alias("count"), fine(F.lit("worker"), k % 17 == 3).alias("roles"),
        F.struct(fine(F.lit("yes"), k % 19 == 4).alias("constructed")).alias("annotations"))
    head = [et.alias("source"), F.when(k % 2 == 0, F.lit("Info")).alias("level"), ((k % 3 != 0) | ~error).alias("display")]
    locator = F.struct(fine(F.lit("Node"), k % 4 == 0).alias("type"), keys.alias("keys"))
    # a few rows hold text where the locator object should be, both payload columns, or none
    payload = F.when(~coarse & (k % 23 == 4), F.to_json(F.struct(*head, F.lit("gone").alias("locator"), message_part.alias("message")))
                     ).otherwise(F.to_json(F.struct(*head, locator.alias("locator"), message_part.alias("message"))))
    none, both, even = eid % 31 == 7, eid % 29 == 3, eid % 2 == 0
    from_time = F.when(coarse, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    return base.select(
        _s(uid).alias("job_id"),
        "event_id",
        from_time.alias("from_time"),
        (from_time + F.lit(dt.timedelta(seconds=1))).alias("to_time"),
        F.when(k % 25 == 24, F.lit("observer")).otherwise(F.lit("collector")).alias("origin"),
        F.when(~none & (both | even), payload).alias("interval"),
        F.when(~none & both, F.lit('{"source":"other"}')).when(~none & ~even, payload).alias("interval_json"),
    )


def jobs_from_customer(customer: DataFrame) -> DataFrame:
    """customer(c_custkey, c_name, c_mktsegment) -> job runs."""
    key = F.col("c_custkey")
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return customer.select(
        _s(key).alias("job_id"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), F.col("c_name")).alias("job_name"),
        F.concat(F.lit("job/"), _s(key)).alias("job_url"),
        (start + F.make_dt_interval(days=(key % 5).cast("int"))).alias("job_start"),
    )


def read_adapted(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(intervals, jobs) for a test-data folder holding ``events`` and ``customer``."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return intervals_from_events(events), jobs_from_customer(customer)
