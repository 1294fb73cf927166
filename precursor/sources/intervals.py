"""Readers for the native interval and job tables.

A source is a table name, a parquet path, or a DataFrame.  Only the columns of
the native schema are selected, so Catalyst prunes everything else at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from precursor.sources.cache import materialize, snapshot

INTERVAL_COLUMNS = ["job_id", "event_id", "from_time", "to_time", "origin", "interval", "interval_json"]
JOB_COLUMNS = ["job_id", "job_name", "job_url", "job_start"]


def _load(spark: SparkSession, source) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str) and ("/" in source or source.endswith(".parquet")):
        return spark.read.parquet(source)
    return spark.table(source)


def spread(df: DataFrame) -> DataFrame:
    """An input of fewer partitions than cores, dealt to all cores before CPU-heavy map work (JSON parsing).

    Only the layout changes; rows carry their ids already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: A filter that is broadcast holds at most this many bucket numbers of content hashes.
_BUCKETS = 1 << 18


def with_content_id(df: DataFrame) -> DataFrame:
    """``df`` with an ``event_id`` made from a row's content and, for repeats, its number among equal rows.

    The ids are the same for any file layout.  A first pass counts 64-bit content hashes alone and
    writes those that repeat.  Rows whose hash cannot be among them (by a filter of bounded size) get
    it as their id where they are read: their payloads are never shuffled, and a filter on the
    result reaches their scan.  Only the others are numbered.
    """
    content = [c for c in INTERVAL_COLUMNS if c != "event_id"]
    same = F.xxhash64(*content)
    repeated = df.select(same.alias("_same")).groupBy("_same").agg(F.count("*").alias("_n")).where("_n > 1").select("_same")
    repeated = materialize(repeated, "repeated", snapshot(df))
    bucket = F.pmod(F.col("_same"), F.lit(_BUCKETS))
    marks = F.broadcast(repeated.select(bucket.alias("_bucket")).distinct())
    rows = df.withColumn("_same", same).withColumn("_bucket", bucket)
    single = rows.join(marks, "_bucket", "left_anti").withColumn("event_id", F.col("_same"))
    # equal rows have equal times; with the time among the keys a filter on it passes the window
    n = F.row_number().over(Window.partitionBy("_same", "from_time").orderBy(*content))
    numbered = rows.join(marks, "_bucket", "left_semi").withColumn("_number", n).withColumn(
        "event_id", F.when(F.col("_number") == 1, F.col("_same")).otherwise(F.xxhash64("_same", "_number"))).drop("_number")
    return single.unionByName(numbered).drop("_same", "_bucket")


def read_intervals(spark: SparkSession, source) -> DataFrame:
    """Native interval rows (``job_id, event_id, from_time, to_time, origin, interval, interval_json``).

    A source without ``event_id`` gets :func:`with_content_id`, so ties are broken alike wherever it is read.
    """
    df = _load(spark, source)
    if "event_id" not in df.columns:
        df = with_content_id(df)
    return df.select(*INTERVAL_COLUMNS)


def read_jobs(spark: SparkSession, source) -> DataFrame:
    """Job runs (``job_id, job_name, job_url, job_start``)."""
    return _load(spark, source).select(*JOB_COLUMNS)

