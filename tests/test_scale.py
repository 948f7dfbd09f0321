"""Plans and row counts that must hold when one key has a third of all rows."""

from __future__ import annotations

from collections import Counter
from datetime import timedelta

import pytest
from rows import PROJECT, at, row
from pyspark.sql import functions as F

import footfall.operators.identity as identity
import footfall.operators.sessions as sessions
from footfall.operators.dedup import first_in_batch, latest_rows
from footfall.operators.funnel import funnel_levels
from footfall.operators.segmentation import segment_counts, segmentation
from footfall.plans.requests import FunnelQuery, FunnelStep, SegmentationQuery, SessionsQuery


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.fixture
def busy(table):
    """A third of the events from one person, a third from one anonymous id, a third from others."""
    rows = [row("a", "bot", at(0) + timedelta(seconds=i // 10)) for i in range(400)]
    rows += [row("a", None, at(0) + timedelta(seconds=i // 10), anonymous_id="kiosk") for i in range(400)]
    rows += [row("b", f"u{i % 40}", at(0, i / 20)) for i in range(400)]
    rows += [row("login", "owner", at(1), anonymous_id="kiosk")]
    return table(rows)


def test_copies_are_cut_to_one_per_task_before_the_shuffle(table):
    same = row("a", "u", at(0))
    events = table([same] * 300 + [row("a", "u", at(0))])
    for kept in (latest_rows(events), first_in_batch(events)):
        plan = plan_of(kept)
        assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
        assert kept.count() == 2


def test_the_busiest_person_has_at_most_a_row_per_slot(spark, busy, no_broadcast):
    query = SessionsQuery(start=at(0), end=at(1), inactivity_minutes=30)
    seen = {}
    by_person = sessions.by_person

    def watched(*given):
        seen["rows"] = by_person(*given)
        return seen["rows"]

    sessions.by_person = watched
    try:
        found = sessions.sessionize(busy, PROJECT, query)
    finally:
        sessions.by_person = by_person
    per_person = {r["person_id"]: r["count"] for r in seen["rows"].groupBy("person_id").count().collect()}
    assert per_person["bot"] == 1 and per_person["owner"] == 2
    assert found.filter("person_id = 'owner'").first()["events"] == 400
    assert found.filter("person_id = 'bot'").first()["events"] == 400


def test_hot_ids_enter_the_shuffle_join_combined(busy, no_broadcast):
    first = identity.first_links(identity.link_rows(busy), PROJECT)
    rows = busy.select(
        "project_id", "user_id", "anonymous_id", "distinct_id",
        F.unix_seconds("timestamp").alias("second"), F.lit(1).alias("steps"),
    )
    resolved = identity.resolve(rows, first, ["second"], {"steps": F.bit_or})
    assert resolved.filter("person_id = 'bot'").count() == 40
    assert resolved.filter("anonymous_id = 'kiosk' and user_id is null").count() == 40
    plan = plan_of(resolved)
    assert "SortMergeJoin" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_funnel_is_the_same_either_way(spark, busy):
    query = FunnelQuery(steps=[FunnelStep("a"), FunnelStep("login")], start=at(0), end=at(2))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    levels = []
    for threshold in (limit, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        levels.append(sorted(map(tuple, funnel_levels(busy, PROJECT, query).collect())))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert levels[0] == levels[1] == [("bot", 1), ("owner", 2)]


def test_breakdown_counts_once(busy):
    """Top segments and series come from one shuffle of the counts."""
    query = SegmentationQuery(event="a", breakdown="x", start=at(0), end=at(1))
    frame = segmentation(busy, PROJECT, query)
    frame.collect()
    assert "ReusedExchange" in plan_of(frame) or "reuses" in plan_of(frame).lower()


def test_json_stays_out_of_the_shuffle(busy):
    query = SegmentationQuery(event="a", breakdown="x", start=at(0), end=at(1))
    plan = plan_of(segment_counts(busy, PROJECT, query))
    above = plan[: plan.index("Partial")]
    assert "properties#" not in above


@pytest.mark.parametrize("broadcast", [True, False])
def test_user_ids_are_not_matched_as_anonymous_ids(spark, table, broadcast):
    rows = [row("a", "kiosk", at(0)), row("login", "owner", at(0), anonymous_id="kiosk")]
    events = table(rows)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        first = identity.first_links(identity.link_rows(events))
        people = identity.with_person(events, first).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r["person_id"] for r in people) == ["kiosk", "owner"]


def test_rows_of_a_hot_device_spread_over_tasks(spark, no_broadcast):
    """One device has 75 % of the rows, and the links come from an aggregate."""
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        n = F.col("id")
        device = F.when(n % 4 < 3, F.lit("kiosk")).otherwise(F.concat(F.lit("device-"), n.cast("string")))
        rows = spark.range(0, 80_000, 1, 40).select(
            F.lit(PROJECT).alias("project_id"), F.lit(None).cast("string").alias("user_id"),
            device.alias("anonymous_id"), device.alias("distinct_id"), F.sha2(n.cast("string"), 256).alias("event_id"),
        )
        links = spark.range(0, 20_000).select(
            F.lit(PROJECT).alias("project_id"),
            F.when(n == 0, F.lit("kiosk")).otherwise(F.concat(F.lit("device-"), (n * 4 - 1).cast("string"))).alias("anonymous_id"),
            F.concat(F.lit("user-"), n.cast("string")).alias("user_id"),
            F.timestamp_seconds(n).alias("linked_at"),
        )
        found = identity.with_person(rows, identity.first_links(links), split_hot=True)
        counted = found.select("person_id", "event_id", F.spark_partition_id().alias("task")).collect()
        plain = identity.with_person(rows, identity.first_links(links)).select("person_id", "event_id").collect()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert sorted((r.person_id, r.event_id) for r in counted) == sorted(map(tuple, plain))
    sizes = sorted(Counter(r.task for r in counted).values())
    assert sum(r.person_id == "user-0" for r in counted) == 60_000
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
