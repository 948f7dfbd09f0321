from __future__ import annotations

from rows import PROJECT, at, row

from footfall.analytics import ProjectAnalytics
from footfall.operators.funnel import funnel
from footfall.operators.identity import identity_links, list_links, merge_links
from footfall.operators.retention import retention
from footfall.operators.segmentation import segmentation
from footfall.plans.requests import (
    FunnelQuery,
    FunnelStep,
    ListingQuery,
    RetentionQuery,
    SegmentationQuery,
    SessionsQuery,
)


def reader_subscribes():
    """A reader on a tablet opens two articles, registers on the third day and subscribes a day later from a phone."""
    return [
        row("article_opened", None, at(0, 6), {"slug": "tides"}, anonymous_id="tablet-71"),
        row("article_opened", None, at(1, 22), {"slug": "kelp"}, anonymous_id="tablet-71"),
        row("registered", "reader-4", at(2, 9), anonymous_id="tablet-71"),
        row("subscribed", "reader-4", at(3, 12), anonymous_id="phone-3"),
    ]


def uniques(events, event, days, links=None):
    query = SegmentationQuery(event=event, measure="unique_users", start=at(0), end=at(days))
    rows = segmentation(events, PROJECT, query, links).orderBy("bucket").collect()
    return [r["value"] for r in rows]


def converted(events, *steps, days=7):
    query = FunnelQuery(steps=[FunnelStep(s) for s in steps], start=at(0), end=at(days))
    return [r["users"] for r in funnel(events, PROJECT, query).orderBy("step").collect()]


def test_links_need_both_ids(table):
    events = table([
        *reader_subscribes(),
        row("registered", "", at(2), anonymous_id="kiosk"),
        row("registered", "reader-8", at(2), anonymous_id=""),
        row("registered", "reader-9", at(2)),
    ])
    links = list_links(identity_links(events), PROJECT).collect()
    assert {(r["anonymous_id"], r["user_id"]) for r in links} == {("tablet-71", "reader-4"), ("phone-3", "reader-4")}


def test_upkeep_is_repeat_safe_and_keeps_the_first_meeting(table):
    early = identity_links(table([row("a", "u", at(0, 1), anonymous_id="x")]))
    late = identity_links(table([row("a", "u", at(0, 5), anonymous_id="x")]))
    merged = merge_links(late, early, late).collect()
    assert [(r["user_id"], r["linked_at"].hour) for r in merged] == [("u", 1)]


def test_funnel_spans_devices_of_one_reader(table):
    assert converted(table(reader_subscribes()), "article_opened", "registered", "subscribed") == [1, 1, 1]
    alone = [r for r in reader_subscribes() if r["event"] != "registered"]
    assert converted(table(alone), "article_opened", "subscribed") == [1, 0]


def test_devices_become_one_reader_when_the_second_link_arrives(table):
    visits = [row("article_opened", None, at(d, 4 + d), anonymous_id=f"device-{d % 3}") for d in range(6)]
    assert uniques(table(visits), "article_opened", 6) == [1] * 6
    spanning = [row("article_opened", None, at(0, 20), anonymous_id="device-1")]
    login = [row("registered", "reader-2", at(9), anonymous_id=f"device-{k}") for k in range(2)]
    assert uniques(table(visits + spanning), "article_opened", 2) == [2, 1]
    assert uniques(table(visits + spanning + login), "article_opened", 2) == [1, 1]


def test_links_made_after_the_range_apply(table):
    events = table([
        row("view", None, at(0), anonymous_id="a1"),
        row("view", None, at(0), anonymous_id="a2"),
        row("login", "u", at(30), anonymous_id="a1"),
        row("login", "u", at(31), anonymous_id="a2"),
    ])
    assert uniques(events, "view", 1) == [1]


def test_a_borrowed_device_belongs_to_who_met_it_first(table):
    """Three readers use one library terminal; what was read before counts for the first, and no two become one."""
    readers = [f"reader-{k}" for k in (5, 1, 3)]
    events = table(
        [row("article_opened", None, at(0, h), anonymous_id="terminal") for h in (1, 2)]
        + [row("registered", reader, at(0, 3 + k), anonymous_id="terminal") for k, reader in enumerate(readers)]
        + [row("subscribed", reader, at(0, 10)) for reader in readers[:2]]
    )
    assert uniques(events, "registered", 1) == [3]
    assert uniques(events, "article_opened", 1) == [1]
    assert converted(events, "article_opened", "subscribed", days=1) == [1, 1]


def test_a_user_id_that_looks_like_an_anonymous_id_is_not_resolved(table):
    events = table([
        row("login", "u", at(0), anonymous_id="x"),
        row("view", "x", at(0)),
        row("view", "u", at(0)),
    ])
    assert uniques(events, "view", 1) == [2]


def test_a_reader_is_retained_on_another_device(table):
    events = table([
        *reader_subscribes(),
        row("article_opened", None, at(16), anonymous_id="phone-3"),  # two weeks on, not signed in
        row("article_opened", None, at(9), anonymous_id="phone-4"),  # nobody's
    ])
    query = RetentionQuery(
        start_event="registered", return_event="article_opened", periods=3, start=at(0), end=at(7)
    )
    rows = retention(events, PROJECT, query).orderBy("offset").collect()
    assert [r["users"] for r in rows] == [1, 0, 1, 0]


def test_one_object_answers_everything(table):
    shop = ProjectAnalytics(table(reader_subscribes()), PROJECT)
    span = {"start": at(0), "end": at(7)}
    listing = ListingQuery(as_of=at(5), days=7)
    steps = [FunnelStep("article_opened"), FunnelStep("subscribed")]
    views = SegmentationQuery(event="article_opened", measure="unique_users", **span)
    assert shop.segmentation(views).first()["total"] == 2
    assert shop.segmentation(views, approximate=True).first()["total"] == 2
    assert shop.funnel(FunnelQuery(steps=steps, **span)).agg({"users": "sum"}).first()[0] == 2
    assert shop.retention(RetentionQuery(start_event="registered", **span)).count() == 9
    assert shop.sessions(SessionsQuery(**span)).count() == 7
    assert shop.session_totals(SessionsQuery(**span)).first()["sessions"] == 4
    assert shop.event_names(listing).count() == 3
    assert shop.violation_counts(listing).count() == 0
    assert shop.identity_links().count() == 2
