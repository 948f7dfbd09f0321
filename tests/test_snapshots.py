"""Stored events: compaction swaps whole states, plans files by bytes, and zone maps spare files."""

from __future__ import annotations

import random
from datetime import timedelta
from pathlib import Path

from rows import PROJECT, at, row

from footfall.operators.dedup import latest_rows
from footfall.operators.scope import current_rows
from footfall.sources import events as store

MONTH = "202606"


def ids(frame):
    return sorted(r["event_id"] for r in frame.select("event_id").collect())


def data_files(path):
    return sorted(str(p) for p in Path(path).rglob("*.parquet"))


def test_a_reader_sees_the_state_before_or_after(spark, table, tmp_path, monkeypatch):
    path = f"{tmp_path}/events"
    first = table([row("e", f"u{i}", at(i % 9)) for i in range(20)])
    store.write_events(first, path, 0)
    store.write_events(first, path, 1)
    seen = []
    publish = store._publish

    def look_first(*given):
        seen.append((store.scan_events(spark, path).count(), store.settled_months(spark, path)))
        done = publish(*given)
        seen.append((store.scan_events(spark, path).count(), store.settled_months(spark, path)))
        return done

    before = store.scan_events(spark, path)
    monkeypatch.setattr(store, "_publish", look_first)
    live = store.compact_month(spark, path, MONTH)
    # The result is written, but counts only from its manifest on; no moment shows both.
    assert seen == [(40, []), (20, [MONTH])]
    assert before.count() == 40  # its files are still there
    monkeypatch.undo()
    assert store.compact_month(spark, path, MONTH) == live  # nothing new
    store.write_events(table([row("late", "v", at(2))]), path, 2)
    assert store.compact_month(spark, path, MONTH) != live
    assert store.scan_events(spark, path).count() == 21 and store.settled_months(spark, path) == [MONTH]
    writes = store.child_dirs(spark, f"{path}/month={MONTH}", "batch_id=")
    assert set(writes) == {live, "2", store._states(spark, path, [MONTH])[MONTH].live}  # one generation of old files


def test_a_compaction_that_dies_or_loses_changes_nothing(spark, table, tmp_path, monkeypatch):
    path = f"{tmp_path}/events"
    store.write_events(table([row("e", f"u{i}", at(i)) for i in range(5)]), path, 0)

    def die(*_):
        raise ConnectionError("gone")

    monkeypatch.setattr(store, "_publish", die)
    try:
        store.compact_month(spark, path, MONTH)
    except ConnectionError:
        pass
    assert store.scan_events(spark, path).count() == 5 and store.settled_months(spark, path) == []
    monkeypatch.setattr(store, "_publish", lambda *_: False)
    assert store.compact_month(spark, path, MONTH) is None
    assert store.scan_events(spark, path).count() == 5
    monkeypatch.undo()
    monkeypatch.setattr(store, "DEAD_HOURS", -1)  # what the dead one left is removed
    live = store.compact_month(spark, path, MONTH)
    assert set(store.child_dirs(spark, f"{path}/month={MONTH}", "batch_id=")) == {"0", live}
    assert store.scan_events(spark, path).count() == 5


def test_a_load_that_is_repeated_after_compaction_is_seen(spark, table, tmp_path):
    path = f"{tmp_path}/events"
    store.load_events(table([row("e", "u", at(1))]), path, "history")
    store.compact_month(spark, path, MONTH)
    store.load_events(table([row("e", "v", at(2)), row("e", "w", at(3))]), path, "history")
    assert store.scan_events(spark, path).count() == 3 and store.settled_months(spark, path) == []
    store.compact_month(spark, path, MONTH)
    assert store.scan_events(spark, path).count() == 3 and store.settled_months(spark, path) == [MONTH]


def test_files_are_planned_from_bytes(spark, table, tmp_path):
    rng = random.Random(4)
    path = f"{tmp_path}/events"
    rows = [row("e", f"u{i}", at(i % 20), {"x": rng.random()}) for i in range(3000)]
    store.write_events(table(rows), path, 0)
    size = sum(Path(f).stat().st_size for f in data_files(path))
    live = store.compact_month(spark, path, MONTH, file_bytes=size // 8)
    files = data_files(f"{path}/month={MONTH}/batch_id={live}")
    assert 7 <= len(files) <= 10
    assert max(Path(f).stat().st_size for f in files) < size // 3
    assert ids(store.scan_events(spark, path)) == sorted(r["event_id"] for r in rows)


def test_zone_maps_spare_most_files(spark, table, tmp_path):
    """A compacted month and micro-batches since, several projects: a query reads under 15 % of the files."""
    rng = random.Random(5)
    path = f"{tmp_path}/events"
    projects = [f"project-{k}" for k in range(6)] + [PROJECT]

    def some(days, count):
        return [
            row(rng.choice("abcdef"), f"u{rng.randrange(9)}", at(rng.choice(days), rng.random() * 23), project=rng.choice(projects))
            for _ in range(count)
        ]

    old = some(range(12), 4000)
    store.write_events(table(old), path, 0)
    size = sum(Path(f).stat().st_size for f in data_files(path))
    store.compact_month(spark, path, MONTH, file_bytes=size // 40)
    fresh = []
    for batch in range(1, 13):  # in the order of time, as a stream writes
        part = some([12 + batch], 20)
        fresh += part
        store.write_events(table(part).coalesce(1), path, batch)
    store.index_month(spark, path, MONTH, committed=11)  # micro-batch 12 is not done
    everything = store.scan_events(spark, path)
    total = len(everything.inputFiles())
    assert total >= 50
    for first, days, names in ((2, 1, ["a"]), (5, 2, []), (15, 1, ["b", "c"]), (24, 1, []), (0, 30, ["a"])):
        limits = (at(first), at(first + days))
        part, settled = store.open_events(spark, path, PROJECT, *limits, names)
        assert settled == []
        wanted = ids(current_rows(everything, PROJECT, *limits, names))
        assert ids(current_rows(part, PROJECT, *limits, names)) == wanted
        expected = {
            r["event_id"] for r in old + fresh
            if r["project_id"] == PROJECT and limits[0] <= r["timestamp"] < limits[1] and (not names or r["event"] in names)
        }
        assert set(wanted) == expected
        if days <= 2:
            assert len(part.inputFiles()) / total < 0.15
    # A compaction after the index takes the micro-batches over, and a new one stays visible.
    store.compact_month(spark, path, MONTH, committed=11)
    state = store._states(spark, path, [MONTH])[MONTH]
    assert [w for writes in state.zones.values() for w in writes] == [state.live]
    part = store.scan_events(spark, path, project_id=PROJECT, start=at(24), end=at(25))
    assert ids(current_rows(part, PROJECT, at(24), at(25))) == ids(current_rows(everything, PROJECT, at(24), at(25)))
    assert latest_rows(store.scan_events(spark, path)).count() == len(old + fresh)


def test_no_table_and_no_match(spark, table, tmp_path):
    path = f"{tmp_path}/events"
    assert store.scan_events(spark, path).count() == 0 and store.settled_months(spark, path) == []
    assert store.compact_month(spark, path, MONTH) is None
    store.write_events(table([row("e", "u", at(0) + timedelta(hours=1))]), path, 0)
    store.compact_month(spark, path, MONTH)
    assert store.scan_events(spark, path, project_id="nobody").count() == 0
    assert store.scan_events(spark, path, start=at(40), end=at(41)).count() == 0
    assert store.scan_events(spark, path, end=at(0, 1)).count() == 0
    assert store.scan_events(spark, path, end=at(0, 2)).count() == 1


def test_files_are_planned_from_rows_that_compress_well_too(spark, table, tmp_path, monkeypatch):
    path = f"{tmp_path}/events"
    rows = [row(f"e{i % 3}", f"u{i % 5}", at(i % 20)) for i in range(1000)]
    store.write_events(table(rows), path, 0)
    monkeypatch.setattr(store, "FILE_ROWS", 100)
    live = store.compact_month(spark, path, MONTH)
    assert 8 <= len(data_files(f"{path}/month={MONTH}/batch_id={live}")) <= 11
    assert ids(store.scan_events(spark, path)) == sorted(r["event_id"] for r in rows)


def test_zone_maps_do_not_sort_the_rows(spark, table, tmp_path):
    path = f"{tmp_path}/events"
    store.write_events(table([row("e", "u", at(1)), row("d", "u", at(5)), row("f", "w", at(3))]), path, 0)
    zones = store._zone_rows(spark.read.parquet(f"{path}/month={MONTH}/batch_id=0"))
    plan = zones._jdf.queryExecution().executedPlan().toString()
    scan_side = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "HashAggregate" in scan_side and "Sort" not in scan_side
    (zone,) = zones.drop("file").collect()
    assert (zone.rows, zone.event_lo, zone.event_hi) == (3, "d", "f")
    assert (zone.project_lo, zone.project_hi) == (PROJECT, PROJECT) and zone.time_lo < zone.time_hi
