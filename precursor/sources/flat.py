"""The flat interval table, partitioned by day, parsed one range of days at a time.

The table of an input snapshot lies under ``<scratch>/precursor/flat-<fingerprint>``: folder ``days`` holds
the rows by ``day`` (the date of ``from_time``), folder ``manifest`` the ranges of days that are finished.
Asking for a range parses only its missing days: their bounds are literal filters on the raw scan, so
row groups outside them are not read, and JSON is parsed behind the filter.  A job that dies
leaves no manifest row; its days are written again as a whole (dynamic partition overwrite).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precursor.functions.payload import flatten_intervals
from precursor.sources.cache import cache_path, exists

DAY = "day"
_ONE_DAY = dt.timedelta(days=1)
Days = tuple[dt.date, dt.date]


def date_of(t: str | dt.datetime | dt.date) -> dt.date:
    if isinstance(t, str):
        t = dt.datetime.fromisoformat(t)
    return t.date() if isinstance(t, dt.datetime) else t


def day_range(first: dt.date, last: dt.date) -> Column:
    """Filter on the partition column: days outside are not listed, let alone read."""
    return F.col(DAY).between(F.lit(first), F.lit(last))


def missing_days(wanted: Days, finished: list[Days]) -> list[Days]:
    """The parts of ``wanted`` that no finished range covers, as ranges of whole days (both ends included)."""
    out, at = [], wanted[0]
    for first, last in sorted(finished):
        if first > wanted[1]:
            break
        if first > at:
            out.append((at, first - _ONE_DAY))
        at = max(at, last + _ONE_DAY)
    if at <= wanted[1]:
        out.append((at, wanted[1]))
    return out


def _in_days(days: Days) -> Column:
    start, end = (F.to_timestamp_ntz(F.lit(f"{d} 00:00:00")) for d in (days[0], days[1] + _ONE_DAY))
    return (F.col("from_time") >= start) & (F.col("from_time") < end)


def raw_rows(intervals: DataFrame, days: list[Days]) -> DataFrame:
    """Native rows of ranges of days (literal bounds, pushed to the scan)."""
    return intervals.where(reduce(Column.__or__, [_in_days(d) for d in days]))


class FlatStore:
    """The flat table of one input snapshot; :meth:`days` and :meth:`all` parse what they lack."""

    def __init__(self, intervals: DataFrame, fp: str):
        self.spark: SparkSession = intervals.sparkSession
        self.intervals = intervals
        self.path = cache_path(self.spark, "flat", fp)
        self.schema = flatten_intervals(intervals).withColumn(DAY, F.to_date("from_time")).schema

    def finished(self) -> tuple[list[Days], bool]:
        """Finished ranges of days, and whether the whole table is finished (one manifest row per parsed range)."""
        if not exists(self.spark, f"{self.path}/manifest/_SUCCESS"):
            return [], False
        rows = self.spark.read.schema("first date, last date").parquet(f"{self.path}/manifest").collect()
        return [(r["first"], r["last"]) for r in rows if r["first"] is not None], any(r["first"] is None for r in rows)

    def _write(self, raw: DataFrame, done: list[tuple[dt.date | None, dt.date | None]]) -> None:
        flat = flatten_intervals(raw).withColumn(DAY, F.to_date("from_time"))
        # days are gathered before the write (a large one is split), and sorted for the statistics of row groups
        flat = flat.hint("rebalance", DAY).sortWithinPartitions(DAY, "from_time")
        flat.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{self.path}/days")
        self.spark.createDataFrame(done, "first date, last date").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/days")

    def days(self, start: str | dt.datetime, end: str | dt.datetime) -> DataFrame:
        """Rows whose day lies in the range (both ends included); only missing days are parsed."""
        wanted = (date_of(start), date_of(end))
        finished, complete = self.finished()
        missing = [] if complete else missing_days(wanted, finished)
        if missing:
            self._write(raw_rows(self.intervals, missing), missing)
        return self._read().where(day_range(*wanted))

    def all(self) -> DataFrame:
        """All rows, also those without a time."""
        finished, complete = self.finished()
        if not complete:
            rest = self.intervals
            for days in finished:
                rest = rest.where(~_in_days(days) | F.col("from_time").isNull())
            self._write(rest, [(None, None)])
        return self._read()
