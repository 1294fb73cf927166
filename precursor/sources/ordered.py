"""O1, O3: a totally ordered table on disk.

Rows are dealt to range partitions and sorted in them; every row keeps its partition number and its
place in it.  The order of the whole table is (partition, place), whatever the order in which files
are listed or read, and the ordinal of a row is its place plus the rows of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, PLACE = "_part", "_place"


def write_ordered(df: DataFrame, path: str, *order: Column | str, mode: str = "overwrite") -> str:
    """Write ``df`` in the order of the columns ``order``; a hot prefix of the order is split by the rest of it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    uid = F.monotonically_increasing_id()  # partition number and place, as the rows leave the sort
    rows = rows.withColumn("_uid", uid).select(
        *df.columns, F.shiftright("_uid", 33).cast("int").alias(PART), F.col("_uid").bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE))
    rows.write.mode(mode).parquet(path)
    return path


def read_ordered(spark: SparkSession, path: str, ordinal: str = "ordinal") -> DataFrame:
    """The rows of an ordered table with their position in it, from 0."""
    rows = spark.read.parquet(path)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(PART).agg(F.count("*").alias("_n")).select(  # one row per range partition
        PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(parts, PART).withColumn(ordinal, F.col("_before") + F.col(PLACE)).drop(PART, PLACE, "_before")
