"""Time buckets in UTC (weeks start on Monday) and the spine of all buckets of a range."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket(column: Column | str, interval: str) -> Column:
    return F.date_trunc(interval, column)


def bucket_starts(start: datetime, end: datetime, interval: str) -> Column:
    """Array of every bucket from the one holding ``start`` while before ``end``."""
    first = F.date_trunc(interval, F.lit(start))
    last = F.lit(end - timedelta(microseconds=1))
    return F.sequence(first, last, F.expr(f"interval 1 {interval}"))


def bucket_spine(spark: SparkSession, start: datetime, end: datetime, interval: str) -> DataFrame:
    """One row per bucket; at most 1,000 by the request guards."""
    return spark.range(1).select(F.explode(bucket_starts(start, end, interval)).alias("bucket"))


def day_floor(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def day_ceil(moment: datetime) -> datetime:
    floor = day_floor(moment)
    return floor if floor == moment else floor + timedelta(days=1)


def millis(column: Column | str) -> Column:
    """Timestamp cut to whole milliseconds, the precision of stored events."""
    return F.date_trunc("millisecond", column)
