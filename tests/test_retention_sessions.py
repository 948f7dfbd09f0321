from __future__ import annotations

import random
from datetime import timedelta

import pytest
from rows import PROJECT, at, row

from footfall.operators.retention import cohort_sizes, retention, retention_matrix
from footfall.operators.sessions import session_report, session_totals, sessionize
from footfall.plans.requests import RetentionQuery, SessionsQuery


def test_cohorts_begin_on_mondays_and_the_first_start_counts(table):
    days = {"kai": ([1, 9], [1, 8, 22]), "lea": ([6], [13, 14, 20]), "mio": ([8], [9, 29]), "noa": ([30], [31])}
    events = table([
        *(row("joined", p, at(d, 8)) for p, (starts, _) in days.items() for d in starts),
        *(row("trained", p, at(d, 19)) for p, (_, back) in days.items() for d in back),
    ])
    query = RetentionQuery(start_event="joined", return_event="trained", periods=3, start=at(0), end=at(21))
    rows = retention(events, PROJECT, query).orderBy("cohort", "offset").collect()
    assert [(str(r["cohort"]), r["size"], r["users"], r["rate"]) for r in rows] == [
        ("2026-06-01", 2, 1, 0.5), ("2026-06-01", 2, 2, 1.0), ("2026-06-01", 2, 1, 0.5), ("2026-06-01", 2, 1, 0.5),
        ("2026-06-08", 1, 1, 1.0), ("2026-06-08", 1, 0, 0.0), ("2026-06-08", 1, 0, 0.0), ("2026-06-08", 1, 1, 1.0),
    ]
    assert [r["size"] for r in cohort_sizes(events, PROJECT, query).orderBy("cohort").collect()] == [2, 1]


def test_long_daily_retention_against_counting(table):
    """52 periods over more than one bitmap word, random activity, start mid-week."""
    rng = random.Random(3)
    rows, starts, active = [], {}, {}
    for person in range(40):
        for _ in range(rng.randint(1, 25)):
            day = rng.randint(0, 120)
            name = rng.choice(["signup", "view"])
            rows.append(row(name, f"u{person}", at(day, rng.randint(0, 23))))
            if name == "signup" and 2 <= day < 70:
                starts[person] = min(starts.get(person, 999), day)
            if 2 <= day < 70 + 52:
                active.setdefault(person, set()).add(day)
    query = RetentionQuery(start_event="signup", period="day", periods=52, start=at(2), end=at(70))
    expected = {}
    for person, first in starts.items():
        for day in active[person]:
            if 0 <= day - first <= 52:
                key = ((at(0) + timedelta(days=first)).date(), day - first)
                expected[key] = expected.get(key, 0) + 1
    got = {
        (r["cohort"], r["offset"]): r["users"]
        for r in retention_matrix(table(rows), PROJECT, query).collect()
    }
    assert got == expected


def minutes(m):
    return at(0, 10 + m / 60)


def report(events, **given):
    query = SessionsQuery(**({"start": at(0), "end": at(1)} | given))
    return session_report(events, PROJECT, query).orderBy("bucket").collect()


def totals(events, **given):
    query = SessionsQuery(**({"start": at(0), "end": at(1)} | given))
    return session_totals(events, PROJECT, query).first()


def test_a_day_of_sessions(table):
    visits = {"ida": (0, 29, 58, 120), "jon": (3,), "kim": (200, 201, 260)}
    [day] = report(table([row("e", person, minutes(m)) for person, at_ in visits.items() for m in at_]))
    # ida: 58 min and one event; jon: one event; kim: 1 min and one event.
    assert (day["sessions"], day["users"], day["bounce_rate"]) == (5, 3, 0.6)
    assert day["avg_duration_seconds"] == 708.0 and day["events_per_session"] == 1.6
    assert totals(table([row("e", "jon", minutes(3))]))["sessions"] == 1


def test_a_gap_as_long_as_the_limit_does_not_split(table):
    events = table([row("e", "u", minutes(m)) for m in (0, 20, 41)])
    found = [totals(events, inactivity_minutes=m)["sessions"] for m in (19, 20, 21, 240)]
    assert found == [3, 2, 1, 1]


def test_sessions_belong_to_the_range_they_begin_in(table):
    events = table([
        *(row("e", "through", at(1, h)) for h in (-0.4, -0.1, 0.3)),
        row("e", "returns", at(1, -1)), row("e", "returns", at(1, 0.1)),
        *(row("e", "leaves", at(1, h)) for h in (23.9, 24.2)),
    ])
    found = totals(events, start=at(1), end=at(2))
    assert found["sessions"] == 2


def test_a_visit_goes_on_when_the_visitor_becomes_known(table):
    events = table([
        *(row("e", None, minutes(m), anonymous_id="tablet") for m in (0, 12)),
        row("signed_in", "user-7", minutes(30), anonymous_id="tablet"),
        *(row("e", "user-7", minutes(m)) for m in (45, 50)),
        row("e", None, minutes(100), anonymous_id="tablet"),
    ])
    [day] = report(events)
    assert (day["sessions"], day["users"], day["events_per_session"]) == (2, 1, 3.0)


def test_days_without_sessions_are_listed(table):
    rows = report(table([row("e", "u", at(3, 1)), row("e", "u", at(1, 1))]), end=at(5))
    assert [r["sessions"] for r in rows] == [0, 1, 0, 1, 0]
    assert totals(table([row("e", "u", at(9))]), end=at(5))["sessions"] == 0


@pytest.mark.parametrize("limit", [1, 7, 30])
def test_sessions_against_walking_through_the_events(table, limit):
    rng = random.Random(limit)
    rows, expected = [], []
    for person in range(25):
        times = sorted(
            at(0, -2) + timedelta(milliseconds=rng.randint(0, 28 * 3_600_000)) for _ in range(rng.randint(1, 60))
        )
        rows += [row("e", f"u{person}", t) for t in times]
        seen = [t for t in times if t >= at(0) - timedelta(minutes=limit)]
        session = []
        for t in [*seen, None]:
            if session and (
                t is None or int(t.timestamp()) - int(session[-1].timestamp()) > limit * 60
            ):
                if at(0) <= session[0] < at(1):
                    expected.append((f"u{person}", session[0].timestamp(), len(session)))
                session = []
            session.append(t)
    query = SessionsQuery(start=at(0), end=at(1), inactivity_minutes=limit)
    found = sessionize(table(rows), PROJECT, query).selectExpr(
        "person_id", "unix_micros(started) / 1e6", "events"
    )
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_cohort_sizes_read_start_events_of_the_range_alone(table):
    rng = random.Random(21)
    rows = [
        row(rng.choice(["joined", "read", "read"]), f"u{rng.randrange(30)}", at(rng.randrange(40), rng.randrange(24))) for _ in range(400)
    ]
    events = table(rows + rows[:50])
    for start_event in ("joined", "read"):
        query = RetentionQuery(start_event=start_event, return_event="read", periods=3, start=at(0, 5), end=at(20, 7))
        sizes = {(r["cohort"], r["size"]) for r in cohort_sizes(events, PROJECT, query).collect()}
        cells = retention(events, PROJECT, query).filter("offset = 0").collect()
        assert sizes == {(r["cohort"], r["size"]) for r in cells}
    plan = cohort_sizes(events, PROJECT, query)._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftleft" not in plan
