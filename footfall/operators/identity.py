"""Identity links and the resolution of events to persons at query time."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ANONYMOUS = ("project_id", "anonymous_id")


def link_rows(events: DataFrame) -> DataFrame:
    """Every sighting of both ids together; one row per event."""
    both = (
        F.col("anonymous_id").isNotNull()
        & F.col("user_id").isNotNull()
        & (F.col("anonymous_id") != "")
        & (F.col("user_id") != "")
    )
    return events.filter(both).select(
        "project_id", "anonymous_id", "user_id", F.col("timestamp").alias("linked_at")
    )


def identity_links(events: DataFrame) -> DataFrame:
    """One row per (project, anonymous id, user) with the first time they met."""
    return merge_links(link_rows(events))


def merge_links(*links: DataFrame) -> DataFrame:
    """Union of link tables, repeat-safe: the earliest sighting of a pair stays."""
    union = links[0]
    for other in links[1:]:
        union = union.unionByName(other)
    return union.groupBy("project_id", "anonymous_id", "user_id").agg(
        F.min("linked_at").alias("linked_at")
    )


def list_links(links: DataFrame, project_id: str) -> DataFrame:
    """The links of one project."""
    return links.filter(F.col("project_id") == project_id).select(
        "anonymous_id", "user_id", "linked_at"
    )


def first_links(links: DataFrame, project_id: str | None = None) -> DataFrame:
    """The user each anonymous id met first, over all time (the query range does not matter)."""
    if project_id is not None:
        links = links.filter(F.col("project_id") == project_id)
    links = links.filter((F.col("anonymous_id") != "") & (F.col("user_id") != ""))
    first = F.min(F.struct("linked_at", "user_id")).getField("user_id")
    return links.groupBy(*ANONYMOUS).agg(first.alias("linked_user"))


def _aggregate(
    rows: DataFrame, keys: list[str], measures: Mapping[str, Callable[[str], Column]]
) -> DataFrame:
    if not measures:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*(fn(name).alias(name) for name, fn in measures.items()))


def with_person(rows: DataFrame, first: DataFrame, split_hot: bool = False) -> DataFrame:
    """Add ``person_id``: the user id, else the user first linked to the anonymous id, else
    the distinct id. Two users never become one person.

    Only rows without a user can match a link. Identified rows carry their user id as join
    key, so a shuffle join spreads them by user and not all onto the NULL key.

    ``split_hot`` is for rows that are not aggregated before: one anonymous id may then have most of them. Adaptive
    execution cuts a skewed partition only where both sides of the join come straight from a shuffle; the links are the
    result of an aggregate, whose partitioning the join would take over. A hash of the id as one more key makes the join
    shuffle the (narrow) links once more, and the rows of a hot id spread over tasks.
    """
    linked = first.select(
        F.col("project_id").alias("_project"), F.col("anonymous_id").alias("_anon"), "linked_user"
    )
    identified = F.col("user_id").isNotNull()
    key = F.when(identified, F.col("user_id")).otherwise(F.col("anonymous_id"))
    rows = rows.withColumn("_key", key)
    same = (F.col("project_id") == F.col("_project")) & (F.col("_key") == F.col("_anon")) & ~identified
    helpers = ["_project", "_anon", "_key", "linked_user"]
    if split_hot:
        rows = rows.withColumn("_hash", F.xxhash64("_key"))
        linked = linked.withColumn("_anon_hash", F.xxhash64("_anon"))
        same &= F.col("_hash") == F.col("_anon_hash")
        helpers += ["_hash", "_anon_hash"]
    person = F.coalesce("user_id", "linked_user", "distinct_id")
    return rows.join(linked, same, "left").withColumn("person_id", person).drop(*helpers)


def resolve(
    rows: DataFrame,
    first: DataFrame,
    grain: list[str],
    measures: Mapping[str, Callable[[str], Column]],
) -> DataFrame:
    """``with_person`` for rows that will be aggregated by ``grain`` and self-merging measures
    (min, max, sum, bit_or).

    Rows are aggregated per raw identity before the join: whatever share of the events one
    anonymous id has, at most one row per grain value of it takes part in the join.
    """
    identity = ["project_id", "user_id", "anonymous_id", "distinct_id"]
    return with_person(_aggregate(rows, [*identity, *grain], measures), first)


def by_person(
    rows: DataFrame,
    first: DataFrame,
    grain: list[str],
    measures: Mapping[str, Callable[[str], Column]],
) -> DataFrame:
    """``groupBy(person_id, *grain)`` with self-merging measures, persons resolved on the way."""
    return _aggregate(resolve(rows, first, grain, measures), ["person_id", *grain], measures)
