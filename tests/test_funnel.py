from __future__ import annotations

import random
from datetime import timedelta

from rows import PROJECT, at, row

from footfall.operators.funnel import funnel, funnel_levels
from footfall.plans.requests import FunnelQuery, FunnelStep, PropertyFilter


def users(events, steps, **given):
    query = FunnelQuery(steps=[s if isinstance(s, FunnelStep) else FunnelStep(s) for s in steps], **given)
    rows = funnel(events, PROJECT, query).orderBy("step").collect()
    return [r["users"] for r in rows], rows


def reading(person, *hits):
    """Events of a library reader: (name, day, hour)."""
    return [row(name, person, at(day, hour)) for name, day, hour in hits]


def test_each_step_needs_the_ones_before_it(table):
    events = table([
        *reading("ana", ("card_issued", 1, 9), ("book_lent", 1, 10), ("book_returned", 4, 0)),
        *reading("ben", ("card_issued", 2, 9), ("book_lent", 2, 9)),
        *reading("cho", ("book_lent", 0, 5), ("card_issued", 0, 6), ("book_returned", 0, 7)),
        *reading("dov", ("card_issued", 3, 0), ("book_returned", 3, 1), ("book_lent", 3, 2)),
        *reading("eva", ("book_lent", 1, 0), ("book_returned", 1, 1)),
    ])
    counts, rows = users(events, ["card_issued", "book_lent", "book_returned"], start=at(0), end=at(10))
    assert counts == [4, 3, 1]
    assert [r["conversion_from_start"] for r in rows] == [1.0, 0.75, 0.25]
    assert [r["conversion_from_previous"] for r in rows] == [1.0, 0.75, 0.3333]


def test_the_window_runs_from_the_entry_and_includes_its_last_second(table):
    hour = timedelta(hours=1)
    rows = []
    for person, late in (("early", 0), ("last", 3600), ("missed", 3601)):
        rows += [row("door", person, at(3)), row("desk", person, at(3) + timedelta(seconds=late))]
    rows += [row("door", "again", at(3)), row("door", "again", at(3, 5)), row("desk", "again", at(3, 5.5))]
    counts, _ = users(table(rows), ["door", "desk"], start=at(3), end=at(4), window_seconds=hour.seconds)
    assert counts == [4, 3]


def test_later_steps_may_fall_behind_the_range_but_entries_may_not(table):
    events = table([
        *reading("inside", ("card_issued", 4, 23), ("book_lent", 5, 3)),
        *reading("before", ("card_issued", 1, 23), ("book_lent", 3, 0)),
        *reading("after", ("card_issued", 5, 0), ("book_lent", 5, 1)),
    ])
    assert users(events, ["card_issued", "book_lent"], start=at(2), end=at(5))[0] == [1, 1]


def test_filters_belong_to_their_step(table):
    events = table([
        row("book_lent", "ana", at(0), {"shelf": "maps"}), row("fine_paid", "ana", at(1), {"cents": 90}),
        row("book_lent", "ben", at(0), {"shelf": "maps"}), row("fine_paid", "ben", at(1), {"cents": 30}),
        row("book_lent", "cho", at(0), {"shelf": "poems"}), row("fine_paid", "cho", at(1), {"cents": 90}),
    ])
    maps = FunnelStep("book_lent", [PropertyFilter("shelf", "eq", "maps")])
    dear = FunnelStep("fine_paid", [PropertyFilter("cents", "gt", 50)])
    assert users(events, [maps, dear], start=at(0), end=at(5))[0] == [2, 1]
    assert users(events, ["book_lent", dear], start=at(0), end=at(5))[0] == [3, 2]


def test_nobody_enters(table):
    events = table([row("purchase", "a", at(0))])
    counts, rows = users(events, ["signup", "purchase"], start=at(0), end=at(7))
    assert counts == [0, 0]
    assert [r["conversion_from_start"] for r in rows] == [0.0, 0.0]


def greedy_level(hits, steps, window, end):
    """Try every entry; from each take the earliest next step inside its window."""
    best = 0
    for start in [s for s, names in hits if steps[0] in names and s < end]:
        at_second, level = start, 1
        same = [s for s, n in hits if s == start][0]
        position = (same, 0)
        while level < len(steps):
            # Within a second, steps may follow each other in step order.
            later = [
                s for s, names in hits
                if steps[level] in names and (s, level) > position and s - start <= window
            ]
            if not later:
                break
            at_second = min(later)
            position = (at_second, level)
            level += 1
        best = max(best, level)
    return best


def test_against_trying_every_entry(table):
    rng = random.Random(7)
    names = ["a", "b", "c"]
    rows, hits = [], {}
    for person in range(60):
        for _ in range(rng.randint(1, 14)):
            second = rng.randint(0, 120)
            name = rng.choice(names)
            rows.append(row(name, f"u{person}", at(0) + timedelta(seconds=second)))
            hits.setdefault(f"u{person}", []).append((second, {name}))
    events = table(rows)
    for steps in (["a", "b", "c"], ["a", "a", "b"], ["c", "b", "a", "c"], ["b", "b"]):
        for window in (5, 20, 60):
            query = FunnelQuery(
                steps=[FunnelStep(s) for s in steps],
                start=at(0),
                end=at(0) + timedelta(seconds=100),
                window_seconds=window,
            )
            got = {r["person_id"]: r["level"] for r in funnel_levels(events, PROJECT, query).collect()}
            limit = 100 + window
            expected = {
                u: greedy_level([h for h in hs if h[0] < limit], steps, window, 100)
                for u, hs in hits.items()
            }
            assert got == {u: n for u, n in expected.items() if n}, (steps, window)
            for stretch in (1, 7, 33, 500) if window == 20 else (13,):
                cut = funnel_levels(events, PROJECT, query, stretch=stretch)
                assert {r["person_id"]: r["level"] for r in cut.collect()} == got, (steps, window, stretch)


def test_plan_combines_before_the_shuffle_and_sorts_once_per_person(spark, table):
    """After dedup: one exchange by (person, second), one by person, and a single sort."""
    events = table([row("a", "u", at(0))])
    query = FunnelQuery(
        steps=[FunnelStep("a"), FunnelStep("b"), FunnelStep("c")], start=at(0), end=at(1)
    )
    plan = funnel_levels(events, PROJECT, query, dedup=False)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("BroadcastExchange")[0]
    assert main.count("Exchange hashpartitioning(person_id") == 2
    assert main.count("Sort [person_id") == 1


def test_a_busy_person_is_cut_into_stretches(spark, table):
    """Three persons, one with most of the seconds: sorts and chains run by (person, stretch), a person meets as summaries."""
    query = FunnelQuery(steps=[FunnelStep("a"), FunnelStep("b"), FunnelStep("c")], start=at(0), end=at(2), window_seconds=90)
    rng = random.Random(3)
    made = [row(rng.choice("abc"), "kiosk", at(0) + timedelta(seconds=60 * k)) for k in range(1500)]
    made += [row("a", "ann", at(0)), row("b", "ann", at(0, 0.02)), row("c", "bo", at(1))]
    events = table(made)
    cut = funnel_levels(events, PROJECT, query, stretch=3600)
    whole = funnel_levels(events, PROJECT, query)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    plan = funnel_levels(events, PROJECT, query, dedup=False, stretch=3600)._jdf.queryExecution().executedPlan()
    windows = [line for line in plan.toString().splitlines() if "Window " in line]
    assert windows and all(", [person_id" in line and "stretch" in line.split(", [person_id")[1] for line in windows)
    assert sum("Sort [person_id" in line for line in plan.toString().splitlines()) == 1
