"""Sessions, found at query time so that late events can still split or join them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalars import rate
from footfall.functions.timebuckets import bucket, bucket_spine
from footfall.operators.identity import by_person, first_links, link_rows
from footfall.operators.scope import Dedup, current_rows
from footfall.plans.requests import SessionsQuery

FOLLOW = timedelta(hours=24)


def sessionize(
    events: DataFrame,
    project_id: str,
    query: SessionsQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
) -> DataFrame:
    """``person_id, started, ended, events`` of every session starting in the range.

    A session ends when the next event is more than the inactivity limit later, in whole
    seconds. Reading starts one limit before the range, so a running session is not mistaken
    for a new one, and stops 24 hours after it.

    Events within one slot as long as the limit can never be split, so each (person, slot) is
    reduced to first, last and count before the shuffle. That bounds the rows of the busiest
    person by the number of slots in the range; only those are sorted.
    """
    gap = timedelta(minutes=query.inactivity_minutes)
    gap_seconds = int(gap.total_seconds())
    rows = current_rows(events, project_id, query.start - gap, query.end + FOLLOW, (), dedup)
    rows = rows.select(
        "project_id",
        "user_id",
        "anonymous_id",
        "distinct_id",
        F.floor(F.unix_seconds("timestamp") / gap_seconds).alias("slot"),
        F.col("timestamp").alias("started"),
        F.col("timestamp").alias("ended"),
        F.lit(1).cast("bigint").alias("events"),
    )
    first = first_links(link_rows(events) if links is None else links, project_id)
    slots = by_person(
        rows, first, ["slot"], {"started": F.min, "ended": F.max, "events": F.sum}
    )
    in_order = Window.partitionBy("person_id").orderBy("slot")
    idle = F.unix_seconds("started") - F.unix_seconds(F.lag("ended").over(in_order))
    opens = F.when(idle <= gap_seconds, F.lit(0)).otherwise(F.lit(1))
    numbered = slots.withColumn("_opens", opens).withColumn(
        "_session", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    found = numbered.groupBy("person_id", "_session").agg(
        F.min("started").alias("started"),
        F.max("ended").alias("ended"),
        F.sum("events").alias("events"),
    )
    inside = (F.col("started") >= F.lit(query.start)) & (F.col("started") < F.lit(query.end))
    return found.filter(inside).drop("_session")


def session_buckets(sessions: DataFrame, interval: str) -> DataFrame:
    """``bucket, sessions, users, total_duration_ms, bounces, total_events``."""
    # Persons stay on their task for the first step; a person is one row per bucket after it.
    per_person = sessions.groupBy(bucket("started", interval).alias("bucket"), "person_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum(F.unix_millis("ended") - F.unix_millis("started")).alias("duration"),
        F.count_if(F.col("events") == 1).alias("bounces"),
        F.sum("events").alias("events"),
    )
    return per_person.groupBy("bucket").agg(
        F.sum("sessions").alias("sessions"),
        F.count(F.lit(1)).alias("users"),
        F.sum("duration").alias("total_duration_ms"),
        F.sum("bounces").alias("bounces"),
        F.sum("events").alias("total_events"),
    )


def _averages(rows: DataFrame) -> dict:
    seconds = F.col("total_duration_ms") / 1000
    return {
        "avg_duration_seconds": rate(seconds, "sessions", 1),
        "bounce_rate": rate("bounces", "sessions"),
        "events_per_session": rate("total_events", "sessions", 2),
    }


def session_report(
    events: DataFrame,
    project_id: str,
    query: SessionsQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
) -> DataFrame:
    """``bucket, sessions, users`` and averages, every bucket present."""
    counted = session_buckets(sessionize(events, project_id, query, links, dedup), query.interval)
    spine = bucket_spine(events.sparkSession, query.start, query.end, query.interval)
    measures = ["sessions", "users", "total_duration_ms", "bounces", "total_events"]
    # Both sides have one row per bucket, at most 1,001.
    dense = spine.join(F.broadcast(counted), "bucket", "left").fillna(0, measures)
    averages = _averages(dense)
    return dense.select(
        "bucket", "sessions", "users", *(column.alias(name) for name, column in averages.items())
    )


def session_totals(
    events: DataFrame,
    project_id: str,
    query: SessionsQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
) -> DataFrame:
    """Session-weighted totals. Users are not additive over buckets, so they have none."""
    counted = session_buckets(sessionize(events, project_id, query, links, dedup), query.interval)
    measures = ["sessions", "total_duration_ms", "bounces", "total_events"]
    totals = counted.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures))
    averages = _averages(totals)
    return totals.select("sessions", *(column.alias(name) for name, column in averages.items()))
