from __future__ import annotations

from datetime import timedelta

import pytest
from rows import PROJECT, at, row
from pyspark.sql import functions as F

from footfall.operators.funnel import funnel
from footfall.operators.listings import event_names, event_summary, violation_counts
from footfall.operators.reports import (
    dead_letter_report,
    freshness_histogram,
    freshness_quantiles,
)
from footfall.plans.requests import FunnelQuery, FunnelStep, ListingQuery
from footfall.sources import generate


def test_demo_data_has_the_stated_rates(spark):
    users = generate.numbered_users(spark, 4_000)
    made = generate.demo_events(users, PROJECT, at(0))
    steps = [FunnelStep(s) for s in ("signup", "checkout_started", "purchase")]
    query = FunnelQuery(steps=steps, start=at(0), end=at(56))
    rows = funnel(made, PROJECT, query).orderBy("step").collect()
    assert rows[0]["users"] == 4_000
    assert rows[1]["conversion_from_previous"] == pytest.approx(0.40, abs=0.03)
    assert rows[2]["conversion_from_previous"] == pytest.approx(0.55, abs=0.03)
    views = generate.page_views(users, PROJECT, at(0)).count()
    assert views / 4_000 == pytest.approx(9.5, abs=0.4)
    visits = generate.return_visits(users, PROJECT, at(0)).count()
    assert visits / 4_000 == pytest.approx(1.8, abs=0.1)
    ids = made.agg(F.count(F.lit(1)), F.count_distinct("event_id")).first()
    assert ids[0] == ids[1]
    again = generate.demo_events(users, PROJECT, at(0))
    assert again.exceptAll(made).count() == 0


def test_load_batches(spark):
    batches = generate.load_batches(spark.range(250).withColumnRenamed("id", "n"), PROJECT, at(0))
    assert sorted(len(r["batch"]) for r in batches.collect()) == [50, 100, 100]


def test_freshness(table):
    delays = [0.05] * 10 + [0.2] * 80 + [4] * 9 + [999]
    events = table([
        row("e", "u", at(0), ingested_at=at(0) + timedelta(seconds=d)) for d in delays
    ])
    found = {r["edge"]: r["events"] for r in freshness_histogram(events).collect()}
    assert (found[0.1], found[0.25], found[5.0], found[float("inf")]) == (10, 80, 9, 1)
    assert len(found) == 11
    quantiles = {r["quantile"]: r["seconds"] for r in freshness_quantiles(events, (0.5, 0.95, 0.999)).collect()}
    assert quantiles[0.5] == pytest.approx(0.1 + 0.15 * 40 / 80)
    assert quantiles[0.95] == pytest.approx(2 + 3 * 5 / 9)
    assert quantiles[0.999] == 300.0


def test_dead_letter_report(spark):
    rows = [
        ("invalid_json", at(0)),
        ("unsupported_schema_version:7", at(0, 0.1)),
        ("unsupported_schema_version:9", at(0, 0.12)),
        ("invalid_json", at(0, 0.2)),
    ]
    letters = spark.createDataFrame(rows, "reason string, failed_at timestamp")
    found = {(r["window_start"].minute, r["reason"]): r["letters"] for r in dead_letter_report(letters).collect()}
    assert found == {
        (0, "invalid_json"): 1,
        (0, "unsupported_schema_version"): 2,
        (10, "invalid_json"): 1,
    }


def test_listings(table):
    twice = row("buy", "u", at(1), violations=["a", "b"])
    events = table([twice, twice, row("buy", "v", at(1), violations=["a"])])
    rows = violation_counts(events, PROJECT, ListingQuery(as_of=at(2), days=7)).collect()
    assert [tuple(r) for r in rows] == [("buy", "a", 3), ("buy", "b", 2)]
    assert [tuple(r) for r in event_summary(events).collect()] == [("buy", 2, 2)]


def test_listings_are_whole_unless_asked_for_less(spark, table):
    rows = [row(f"event {k:03d}", "u", at(0), violations=[f"rule {k % 300}"]) for k in range(600)]
    events = table(rows)
    everything = ListingQuery(as_of=at(2), days=7)
    assert event_names(events, PROJECT, everything).count() == 600
    assert violation_counts(events, PROJECT, everything).count() == 600
    few = ListingQuery(as_of=at(2), days=7, limit=3)
    assert [r["event"] for r in event_names(events, PROJECT, few).collect()] == ["event 000", "event 001", "event 002"]
    assert violation_counts(events, PROJECT, few).count() == 3
    with pytest.raises(ValueError, match="limit"):
        ListingQuery(as_of=at(2), limit=0)
