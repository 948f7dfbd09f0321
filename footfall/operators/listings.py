"""Listings over the stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.dedup import latest_rows
from footfall.operators.scope import project_rows
from footfall.plans.requests import ListingQuery


def _listed(counts: DataFrame, query: ListingQuery, *ties: str) -> DataFrame:
    """Most frequent first; all of them unless the query asks for fewer."""
    ordered = counts.orderBy(F.desc("count"), *ties)
    return ordered if query.limit is None else ordered.limit(query.limit)


def event_names(events: DataFrame, project_id: str, query: ListingQuery) -> DataFrame:
    """Event names seen recently, most frequent first; stored rows, copies included."""
    rows = project_rows(events, project_id, query.start, query.end)
    counts = rows.groupBy("event").agg(F.count(F.lit(1)).alias("count"))
    return _listed(counts, query, "event")


def violation_counts(events: DataFrame, project_id: str, query: ListingQuery) -> DataFrame:
    """Recorded tracking-plan violations, most frequent first; copies included."""
    rows = project_rows(events, project_id, query.start, query.end)
    found = rows.select("event", F.explode("violations").alias("violation"))
    counts = found.groupBy("event", "violation").agg(F.count(F.lit(1)).alias("count"))
    return _listed(counts, query, "event", "violation")


def event_summary(events: DataFrame) -> DataFrame:
    """Per event name: rows after dedup and exact distinct ids."""
    per_id = latest_rows(events).groupBy("event", "distinct_id").agg(
        F.count(F.lit(1)).alias("rows")
    )
    return per_id.groupBy("event").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("distinct_ids")
    )


def project_row_count(events: DataFrame, project_id: str) -> DataFrame:
    """Stored rows of one project, copies included."""
    return events.filter(F.col("project_id") == project_id).agg(F.count(F.lit(1)).alias("rows"))
