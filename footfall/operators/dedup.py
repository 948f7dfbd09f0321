"""Removing duplicate events.

All three forms rank the copies of a key and keep rank one. Spark keeps only the best copy of
each key per task before the shuffle (WindowGroupLimit), so a key with very many copies
reaches its reducer as one row per task, never as the whole group.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _best(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    ranked = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.filter("_rank = 1").drop("_rank")


def latest_rows(events: DataFrame, constant: Collection[str] = ()) -> DataFrame:
    """Read-time dedup: among rows equal on (project, day, event, distinct_id, event_id) keep
    the one stored last.

    Filters on those key columns may come before; all others belong after it. ``event_id``
    leads the key because it tells rows apart at the first sort comparison. Key columns in
    ``constant`` have one value in all rows and are left out of sort and shuffle.
    """
    keys = [F.col(c) for c in ("event_id", "distinct_id", "event") if c not in constant]
    keys.append(F.to_date("timestamp"))
    if "project_id" not in constant:
        keys.append(F.col("project_id"))
    newest = [F.desc("ingested_at"), F.desc("kafka_offset"), F.desc("timestamp")]
    return _best(events, keys, newest)


def first_in_batch(rows: DataFrame) -> DataFrame:
    """In-batch dedup: the first row per (project, event id) in log order."""
    return _best(
        rows,
        [F.col("event_id"), F.col("project_id")],
        [F.asc("kafka_partition"), F.asc("kafka_offset")],
    )


def drop_recently_stored(
    rows: DataFrame, stored: DataFrame, now: Column | str, window: str = "24 hours"
) -> DataFrame:
    """Windowed dedup: drop rows whose id was stored less than ``window`` before ``now``.

    ``stored`` holds (project_id, event_id, stored_at). Only new rows are ever recorded there,
    so a duplicate does not extend the window.
    """
    now = F.col(now) if isinstance(now, str) else now
    recent = (
        stored.filter(F.col("stored_at") > now - F.expr(f"interval {window}"))
        .filter(F.col("stored_at") <= now)
        .select("project_id", "event_id")
    )
    return rows.join(recent, ["project_id", "event_id"], "left_anti")


def remembered_ids(rows: DataFrame, stored_at: Column | str) -> DataFrame:
    """What ``drop_recently_stored`` needs to know about newly stored rows."""
    stored_at = F.col(stored_at) if isinstance(stored_at, str) else stored_at
    return rows.select("project_id", "event_id", stored_at.alias("stored_at"))
