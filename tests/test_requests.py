from __future__ import annotations

from datetime import datetime

import pytest
from rows import at

from footfall.plans.requests import (
    FunnelQuery,
    FunnelStep,
    ListingQuery,
    PropertyFilter,
    RetentionQuery,
    SegmentationQuery,
    SessionsQuery,
)


@pytest.mark.parametrize(
    ("make", "message"),
    [
        (lambda: SegmentationQuery(event="e", interval="hour", start=at(0), end=at(60)), "buckets exceed"),
        (lambda: SegmentationQuery(event="e", start=at(0), end=at(400)), "exceeds 366 days"),
        (lambda: SegmentationQuery(event="e", start=at(1), end=at(0)), "must be after"),
        (lambda: SegmentationQuery(event="e", start=datetime(2026, 1, 1), end=at(0)), "time zone"),
        (lambda: SegmentationQuery(event="", start=at(0), end=at(1)), "1 to 128"),
        (lambda: SegmentationQuery(event="e" * 129, start=at(0), end=at(1)), "1 to 128"),
        (lambda: SegmentationQuery(event="e", interval="month", start=at(0), end=at(1)), "interval"),
        (
            lambda: SegmentationQuery(
                event="e", start=at(0), end=at(1), filters=[PropertyFilter("p", "is_set")] * 11
            ),
            "at most 10",
        ),
        (lambda: PropertyFilter("v", "gt", "x"), "needs a number"),
        (lambda: PropertyFilter("v", "gt", True), "needs a number"),
        (lambda: PropertyFilter("v", "eq"), "needs a value"),
        (lambda: PropertyFilter("v", "contains", 3), "needs a string"),
        (lambda: PropertyFilter("v", "like", "x"), "unknown operator"),
        (lambda: PropertyFilter("", "is_set"), "1 to 128"),
        (lambda: FunnelQuery(steps=[FunnelStep("a")], start=at(0), end=at(1)), "2 to 10 steps"),
        (lambda: FunnelQuery(steps=[FunnelStep("a")] * 11, start=at(0), end=at(1)), "2 to 10 steps"),
        (
            lambda: FunnelQuery(
                steps=[FunnelStep("a")] * 2, start=at(0), end=at(1), window_seconds=91 * 86_400
            ),
            "window_seconds",
        ),
        (lambda: RetentionQuery(start_event="a", start=at(0), end=at(1), periods=53), "periods"),
        (lambda: RetentionQuery(start_event="a", start=at(0), end=at(1), period="month"), "period"),
        (lambda: SessionsQuery(start=at(0), end=at(1), inactivity_minutes=241), "inactivity"),
        (lambda: SessionsQuery(start=at(0), end=at(1), inactivity_minutes=0), "inactivity"),
        (lambda: ListingQuery(as_of=at(0), days=91), "days"),
    ],
)
def test_guards(make, message):
    with pytest.raises(ValueError, match=message):
        make()


def test_bounds_are_cut_to_milliseconds():
    query = SessionsQuery(start=at(0).replace(microsecond=1999), end=at(1))
    assert query.start.microsecond == 1000
