"""The rows a query may see: one project, one time range, one copy per event."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.timebuckets import day_ceil, day_floor
from footfall.operators.dedup import latest_rows


def in_range(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``start <= timestamp < end``, plus the months this implies where the table has them."""
    rows = events.filter((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))
    if "month" in events.columns:
        first, last = start.astimezone(UTC), end.astimezone(UTC) - timedelta(microseconds=1)
        rows = rows.filter(F.col("month").between(f"{first:%Y%m}", f"{last:%Y%m}"))
    return rows


def project_rows(
    events: DataFrame,
    project_id: str,
    start: datetime,
    end: datetime,
    event_names: Collection[str] = (),
) -> DataFrame:
    """Base filter without dedup (the two listings read this way)."""
    rows = in_range(events.filter(F.col("project_id") == project_id), start, end)
    return rows.filter(F.col("event").isin(sorted(event_names))) if event_names else rows


Dedup = bool | Collection[str]


def _months(start: datetime, end: datetime) -> list[str]:
    month, last = start.astimezone(UTC), end.astimezone(UTC) - timedelta(microseconds=1)
    found = []
    while f"{month:%Y%m}" <= f"{last:%Y%m}":
        found.append(f"{month:%Y%m}")
        month = month.replace(day=1) + timedelta(days=32)
    return found


def current_rows(
    events: DataFrame,
    project_id: str,
    start: datetime,
    end: datetime,
    event_names: Collection[str] = (),
    dedup: Dedup = True,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Base filter with one copy per event.

    The dedup key holds the day, so whole days are read, then de-duplicated, and only then cut
    to the exact range: the copy stored last decides which time an event has.

    ``dedup`` may name the months compaction has settled (``settled_months``): they hold one
    copy per event already, and as a key never spans months they skip the dedup and its shuffle.
    ``False`` skips it for all.

    ``carry`` names columns to compute from each row before the dedup. What a query needs from
    the JSON goes there: then the shuffle moves the results and not the JSON text.
    """

    def read(source: DataFrame, first: datetime, last: datetime) -> DataFrame:
        rows = project_rows(source, project_id, first, last, event_names)
        return rows.withColumns(carry) if carry else rows

    wanted = _months(start, end)
    settled = [] if dedup is True else [m for m in wanted if dedup is False or m in dedup]
    if len(settled) == len(wanted):
        return read(events, start, end)
    is_settled = F.col("month").isin(settled)
    fresh = events.filter(~is_settled) if settled else events
    days = (day_floor(start), day_ceil(end))
    constant = ("project_id", "event") if len(event_names) == 1 else ("project_id",)
    kept = latest_rows(read(fresh, *days), constant)
    if days != (start, end):
        kept = kept.filter((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end)))
    return kept.unionByName(read(events.filter(is_settled), start, end)) if settled else kept
