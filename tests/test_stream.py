from __future__ import annotations

import json
import shutil
import time
import uuid
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from rows import PROJECT, at, row
from pyspark.sql import functions as F

import footfall.streaming.job as job
from footfall.operators.dedup import drop_recently_stored, latest_rows
from footfall.operators.identity import merge_links
from footfall.operators.reports import backlog, offsets_from_progress, total_backlog
from footfall.operators.scope import current_rows
from footfall.schemas import RAW_MESSAGES
from footfall.sources.events import (
    compact_month,
    drop_months_before,
    load_events,
    months,
    open_events,
    scan_events,
    settled_months,
    write_events,
)
from footfall.sources.raw_topic import dead_letter_records, read_raw_stream
from footfall.streaming.messages import dead_letters, event_rows, parse_messages


def message(**given) -> dict:
    now = "2026-06-01T10:00:00.123456+00:00"
    base = {
        "schema_version": 1, "project_id": PROJECT, "event_id": str(uuid.uuid4()), "event": "signup",
        "distinct_id": "u-1", "user_id": "u-1", "anonymous_id": None, "timestamp": now,
        "client_timestamp": None, "sent_at": None, "received_at": now, "ip": "10.0.0.1",
        "properties": {"plan": "pro"}, "context": {},
    }
    return {k: v for k, v in (base | given).items() if v is not ...}


def records(spark, *values, start=0):
    rows = []
    for number, value in enumerate(values, start):
        body = value if isinstance(value, bytes) else json.dumps(value).encode()
        rows.append((f"k{number}".encode(), body, "events.raw", 0, number))
    return spark.createDataFrame(rows, RAW_MESSAGES)


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        (message(), None),
        (b"\x00not json", "invalid_json"),
        (b"{broken json", "invalid_json"),
        (b'{"schema_version": 1} x', "invalid_json"),
        (b'{"schema_version": 1}],[{}', "invalid_json"),
        (b'{"schema_version": 1}]', "invalid_json"),
        (b'{"schema_version": 1}] rest', "invalid_json"),
        (b'{"schema_version": 1},"x"', "invalid_json"),
        (b'{"schema_version": 1},"x"] {', "invalid_json"),
        (b'"open', "invalid_json"),
        (b'"open\\', "invalid_json"),
        (b"  ", "invalid_json"),
        (b" {} \n", "unsupported_schema_version:None"),
        (b'{"schema_version": 2, "schema_version": 3}', "unsupported_schema_version:3"),
        (b"\xff\xfe", "invalid_json"),
        (b"", "invalid_json"),
        (b"[1, 2, 3]", "not_an_object"),
        (b'"text"', "not_an_object"),
        (b"null", "not_an_object"),
        ({}, "unsupported_schema_version:None"),
        (message(schema_version=99), "unsupported_schema_version:99"),
        (message(schema_version="1"), "unsupported_schema_version:1"),
        (message(event_id="not-a-uuid"), "invalid_message:event_id:Input should be a valid UUID"),
        (message(project_id=...), "invalid_message:project_id:Field required"),
        (message(event=5, ip=7), "invalid_message:event:Input should be a valid string"),
        (message(user_id=...), "invalid_message:user_id:Field required"),
        (message(timestamp=None), "invalid_message:timestamp:Input should be a valid datetime"),
        (
            message(received_at="2026-06-01T10:00:00"),
            "invalid_message:received_at:Input should have timezone info",
        ),
        (message(properties=[]), "invalid_message:properties:Input should be a valid dictionary"),
        (message(violations="x"), "invalid_message:violations:Input should be a valid list"),
        (message(violations=["a", 1]), "invalid_message:violations.1:Input should be a valid string"),
        (message(unknown_field=1), None),
    ],
)
def test_parse_reasons(spark, value, reason):
    assert parse_messages(records(spark, value)).first()["reason"] == reason


def test_a_message_is_parsed_once(spark):
    plan = parse_messages(records(spark, message()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert not any(other in plan for other in ("from_json", "json_object_keys", "JsonToStructs", "StaticInvoke(JsonE"))


def test_rows_carry_lineage_and_defaults(spark):
    body = message(event_id="0123456789ABCDEF0123456789ABCDEF", properties={"b": 1, "a": {"x": [1]}})
    [stored] = event_rows(parse_messages(records(spark, body, start=41))).collect()
    assert (stored["event"], stored["distinct_id"]) == ("signup", "u-1")
    assert (stored["kafka_partition"], stored["kafka_offset"]) == (0, 41)
    assert stored["event_id"] == "01234567-89ab-cdef-0123-456789abcdef"
    assert json.loads(stored["properties"]) == {"b": 1, "a": {"x": [1]}}
    assert stored["violations"] == []
    assert stored["timestamp"].microsecond == 123000


def test_dead_letters_keep_the_original_bytes(spark):
    letters = dead_letters(parse_messages(records(spark, b"{broken", message())))
    [letter] = letters.collect()
    assert (bytes(letter["value"]), bytes(letter["key"]), letter["source_offset"]) == (b"{broken", b"k0", 0)
    [record] = dead_letter_records(letters).collect()
    headers = {h["key"]: bytes(h["value"]).decode() for h in record["headers"]}
    assert headers == {
        "error": "invalid_json",
        "source_topic": "events.raw",
        "source_partition": "0",
        "source_offset": "0",
    }


class Runner:
    """One store fed by files; every ``run`` drains what is there and stops."""

    def __init__(self, spark, root, dedup):
        self.spark, self.root, self.dedup = spark, root, dedup
        self.store = job.Store(f"{root}/store")
        self.sent = 0

    def send(self, *values):
        log = records(self.spark, *values, start=self.sent)
        log.coalesce(1).write.mode("append").json(f"{self.root}/log")
        self.sent += len(values)

    def run(self):
        raw = read_raw_stream(self.spark, path=f"{self.root}/log")
        query = job.start_stream(raw, self.store, dedup=self.dedup, available_now=True)
        query.awaitTermination()
        return query

    def rows(self):
        return scan_events(self.spark, self.store.events)

    def report(self, consumed=None):
        """The report; with ``consumed`` it waits until progress of so many rows has arrived."""
        names = ("consumed", "inserted", "duplicates", "dead_lettered")
        for _ in range(60):
            rows = job.batch_report(self.spark, self.store).orderBy("batch_id").collect()
            found = [tuple(r[n] for n in names) for r in rows]
            if consumed is None or sum(f[0] for f in found) == consumed:
                return found
            time.sleep(0.5)
        return found


@pytest.fixture(params=["ttl", "exact", "state"])
def runner(request, spark, tmp_path):
    return Runner(spark, str(tmp_path), request.param)


def test_retries_repeats_and_poison(runner):
    original = message(event="purchase", anonymous_id="anon-1")
    retry = original | {"timestamp": "2026-06-01T10:00:03+00:00"}
    same = message(event="page_viewed")
    poison = (b"{broken json", {"schema_version": 7})
    runner.send(original, same, same, same, *poison)
    runner.run()
    assert runner.rows().count() == 2
    runner.send(retry, message(event="good"))
    runner.run()
    assert sorted(r["event"] for r in runner.rows().collect()) == ["good", "page_viewed", "purchase"]
    letters = job.stored_letters(runner.spark, runner.store).collect()
    assert sorted(r["reason"] for r in letters) == ["invalid_json", "unsupported_schema_version:7"]
    assert {bytes(r["value"]) for r in letters} == {poison[0], json.dumps(poison[1]).encode()}
    links = merge_links(job.stored_links(runner.spark, runner.store)).collect()
    assert [(r["anonymous_id"], r["user_id"]) for r in links] == [("anon-1", "u-1")]
    assert runner.report(consumed=8) == [(6, 2, 2, 2), (2, 1, 1, 0)]
    if runner.dedup != "state":
        kept = runner.rows().filter("event = 'purchase'").first()
        assert kept["timestamp"].second == 0  # the first copy stays


def test_letters_go_to_the_chosen_sink(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), "exact")
    runner.send(message(), b"{broken", b"[]")
    raw = read_raw_stream(spark, path=f"{runner.root}/log")

    def sink(letters, batch_id):
        dead_letter_records(letters).write.parquet(f"{tmp_path}/letters/{batch_id}")

    job.start_stream(raw, runner.store, available_now=True, letter_sink=sink).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/letters/0").count() == 2
    assert job.stored_letters(spark, runner.store).count() == 0 and runner.report() == [(3, 1, 0, 2)]


def test_a_batch_of_copies_alone_is_reported(runner):
    sent = [message(event=f"e{k}") for k in range(5)]
    runner.send(*sent)
    runner.run()
    runner.send(*sent, *sent)
    runner.run()
    assert runner.rows().count() == 5
    assert runner.report(consumed=15) == [(5, 5, 0, 0), (10, 0, 10, 0)]


def test_compaction_during_a_micro_batch_takes_no_links_or_ids(runner, monkeypatch):
    """The month is compacted right after the rows were written and before links are found."""
    write = job.write_events

    def then_compact(rows, path, batch_id):
        write(rows, path, batch_id)
        for month in months(runner.spark, path):
            compact_month(runner.spark, path, month)

    monkeypatch.setattr(job, "write_events", then_compact)
    sent = [message(event="signup", anonymous_id=f"anon-{k}", user_id=f"u-{k}") for k in range(4)]
    runner.send(*sent)
    runner.run()
    assert runner.report(consumed=4) == [(4, 4, 0, 0)]
    assert merge_links(job.stored_links(runner.spark, runner.store)).count() == 4
    monkeypatch.undo()
    runner.send(*sent)
    runner.run()
    assert runner.rows().count() == 4 and runner.report(consumed=8)[1] == (4, 0, 4, 0)


def test_compaction_leaves_micro_batches_that_are_not_done(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), "exact")
    runner.send(message(), message())
    runner.run()
    assert job.committed_batch(spark, runner.store) == 0
    [month] = months(spark, runner.store.events)
    before = runner.rows().drop("batch_id").collect()
    job.write_events(runner.rows().limit(1), runner.store.events, 1)  # written, not yet committed
    target = compact_month(spark, runner.store.events, month, job.committed_batch(spark, runner.store))
    stored = scan_events(spark, runner.store.events).select("batch_id").distinct().collect()
    assert {r[0] for r in stored} == {target, "1"} and settled_months(spark, runner.store.events) == []
    table, settled = open_events(spark, runner.store.events)
    assert table.count() == 3 and settled == [] and latest_rows(table).count() == len(before)


def test_crash_before_commit_is_replayed_onto_itself(runner, monkeypatch):
    runner.send(message(event="important"), b"{broken", message(event="other"))
    store_batch = job.store_batch

    def crash_after(*given):
        store_batch(*given)
        raise ConnectionError("lost right before the commit")

    monkeypatch.setattr(job, "store_batch", crash_after)
    with pytest.raises(Exception, match="lost right before"):
        runner.run()
    monkeypatch.undo()
    runner.run()
    assert sorted(r["event"] for r in runner.rows().collect()) == ["important", "other"]
    assert job.stored_letters(runner.spark, runner.store).count() == 1
    assert len(runner.report()) == 1


def test_nothing_is_stored_while_the_sink_is_down(runner, monkeypatch):
    runner.send(message(event="important"))

    def down(*_):
        raise ConnectionError("unreachable")

    monkeypatch.setattr(job, "write_events", down)
    with pytest.raises(Exception, match="unreachable"):
        runner.run()
    assert runner.store.read(runner.spark, runner.store.events, job.EVENTS).count() == 0
    monkeypatch.undo()
    runner.run()
    assert [r["event"] for r in runner.rows().collect()] == ["important"]


def test_lost_dedup_window_still_dedups_when_read(runner):
    same = message()
    runner.send(same)
    runner.run()
    # The window is gone: the id is stored again, and reading collapses the copies.
    shutil.rmtree(runner.store.checkpoint)
    shutil.rmtree(runner.store.stored_ids, ignore_errors=True)
    runner.send(same)
    first = runner.rows().collect()
    moved = f"{runner.root}/old"
    runner.spark.createDataFrame(first, runner.rows().schema).drop("month", "batch_id").write.parquet(moved)
    runner.run()
    stored = runner.rows().drop("month", "batch_id").unionByName(runner.spark.read.parquet(moved))
    assert stored.count() == 2
    assert latest_rows(stored).count() == 1


def test_backlog_from_progress(runner, spark):
    runner.send(message(), b"x")
    progress = job.report_from_progress(spark, runner.run())
    assert progress.agg(F.sum("consumed")).first()[0] == 2
    kafka = spark.createDataFrame(
        [('{"t":{"0":10,"1":4}}', '{"t":{"0":7,"1":9}}')], "latest_offset string, end_offset string"
    )
    behind = backlog(
        offsets_from_progress(kafka, "latest_offset"), offsets_from_progress(kafka, "end_offset")
    )
    assert {r["partition"]: r["behind"] for r in behind.collect()} == {0: 3, 1: 0}
    assert total_backlog(behind).first()["behind"] == 3


def test_old_ids_are_forgotten(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), "exact")
    same = message()
    runner.send(same)
    runner.run()
    assert job.forget_ids(spark, runner.store, datetime.now(UTC) - timedelta(hours=24)) == []
    assert len(job.forget_ids(spark, runner.store, datetime.now(UTC) + timedelta(hours=2))) == 1
    runner.send(same)
    runner.run()
    assert [r[1] for r in runner.report()] == [1, 1]


def test_an_id_is_forgotten_one_window_after_it_was_stored(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), "ttl")
    same = [message() for _ in range(3)]

    def drain(window):
        raw = read_raw_stream(spark, path=f"{runner.root}/log")
        job.start_stream(raw, runner.store, window=window, available_now=True).awaitTermination()

    runner.send(*same)
    drain("20 seconds")
    stored = time.time()
    runner.send(*same)
    drain("20 seconds")
    assert time.time() - stored < 20, "too slow a machine for this window"
    time.sleep(max(0, stored + 21 - time.time()))  # a copy in between did not extend it
    runner.send(*same, *same)
    drain("20 seconds")
    assert runner.report() == [(3, 3, 0, 0), (3, 0, 3, 0), (6, 3, 3, 0)]


def test_first_in_log_order_stays_whatever_the_order_of_arrival(spark, tmp_path):
    runner = Runner(spark, str(tmp_path), "ttl")
    ids = [str(uuid.uuid4()) for _ in range(20)]
    sent = [message(event_id=ids[k % 20], event=f"e{k // 20}") for k in range(200)]
    runner.sent = 0
    log = records(spark, *sent).repartition(6)
    log.write.mode("append").json(f"{runner.root}/log")
    runner.run()
    assert {(r["event"], r["kafka_offset"] < 20) for r in runner.rows().collect()} == {("e0", True)}
    assert runner.report() == [(200, 20, 180, 0)]


def test_a_micro_batch_reads_no_ids_of_the_window(spark, tmp_path, monkeypatch):
    """Cost per micro-batch: the state is asked for its own ids, and no table of ids exists."""
    runner = Runner(spark, str(tmp_path), "ttl")
    monkeypatch.setattr(job, "drop_recently_stored", None)
    monkeypatch.setattr(job, "remembered_ids", None)
    for k in range(3):
        runner.send(*(message() for _ in range(4)))
        progress = runner.run().lastProgress
        assert progress.numInputRows == 4
    assert not (tmp_path / "store" / "stored_ids").exists()
    assert sum(r[1] for r in runner.report()) == 12


def test_window_is_24_hours_from_storing(spark):
    rows = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "project_id string, event_id string")
    now = datetime(2026, 6, 2, tzinfo=UTC)
    stored = spark.createDataFrame(
        [("p", "a", at(0, 0.001)), ("p", "b", at(0))], "project_id string, event_id string, stored_at timestamp"
    )
    kept = drop_recently_stored(rows, stored, F.lit(now)).collect()
    assert sorted(tuple(r) for r in kept) == [("p", "b"), ("q", "a")]


def test_table_writes_compaction_and_month_drop(spark, table, tmp_path):
    path = f"{tmp_path}/events"
    rows = [row("e", f"u{i}", at(i * 9)) for i in range(10)]
    events = table(rows)
    write_events(events, path, 7)
    write_events(events, path, 7)  # a replay
    assert scan_events(spark, path).count() == 10
    write_events(events, path, 8)  # copies under another write
    assert scan_events(spark, path).count() == 20
    assert months(spark, path) == ["202606", "202607", "202608"]
    for month in months(spark, path):
        compact_month(spark, path, month)
    assert scan_events(spark, path).count() == 10
    assert settled_months(spark, path) == ["202606", "202607", "202608"]
    write_events(events.filter("timestamp >= '2026-08-01'"), path, 9)
    settled = settled_months(spark, path)
    assert settled == ["202606", "202607"]
    # Settled months skip the dedup, the others do not; the rows are the same.
    stored = scan_events(spark, path)
    for span in ((at(0), at(100)), (at(3, 5), at(40)), (at(65), at(90))):
        ids = [
            sorted(r["event_id"] for r in current_rows(stored, PROJECT, *span, dedup=d).collect())
            for d in (True, settled)
        ]
        assert ids[0] == ids[1]
        assert len(ids[0]) == sum(span[0] <= r["timestamp"] < span[1] for r in rows)
    plan = current_rows(stored, PROJECT, at(0), at(30), dedup=settled)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    compact_month(spark, path, "202608")
    assert drop_months_before(spark, path, "202607") == ["202606"]
    assert months(spark, path) == ["202607", "202608"]
    assert scan_events(spark, path).count() == sum(r["timestamp"].month > 6 for r in rows)


def test_old_files_read_no_violations(spark, table, tmp_path):
    path = f"{tmp_path}/events"
    load_events(table([row("e", "u", at(0))]), path, "new")
    old = table([row("e", "v", at(1))]).drop("violations")
    old.write.parquet(f"{path}/month=202606/batch_id=old")
    assert [r["violations"] for r in scan_events(spark, path).collect()] == [[], []]


def test_scan_prunes_months_and_pushes_the_key(spark, table, tmp_path):
    path = f"{tmp_path}/events"
    load_events(table([row("e", "u", at(40 * i)) for i in range(4)]), path, "b")
    rows = current_rows(scan_events(spark, path), PROJECT, at(0), at(20), ["e"])
    plan = rows.select("timestamp")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "month" in scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]
    pushed = scan[scan.index("PushedFilters") :]
    assert all(name in pushed for name in ("project_id", "timestamp", "event"))
    assert "properties" not in pushed[pushed.index("ReadSchema") :]
    assert rows.count() == 1


def test_ids_are_remembered_by_bucket_not_one_by_one(spark, tmp_path):
    """300 ids in 5 buckets are a few entries of the state store, not 300, and the messages come back as they were."""
    from footfall.streaming import seen

    runner = Runner(spark, str(tmp_path), "ttl")
    body = 'quote " backslash \\ newline \n snow ☃'
    sent = [message(event=body if k % 2 else "", user_id=None) for k in range(300)]
    runner.send(*sent, *sent[:50])
    parsed = job.parse_messages(read_raw_stream(spark, path=f"{runner.root}/log"))
    with job._state_settings(spark):
        query = (
            seen.flag_copies(parsed, 3_600_000, buckets=5)
            .writeStream.format("memory").queryName("flagged")
            .option("checkpointLocation", str(tmp_path / "flagged"))
            .trigger(availableNow=True).start()
        )
    query.awaitTermination()
    flagged = spark.table("flagged")
    assert flagged.agg(F.sum("copies"), F.count_if(F.expr("copies = 0"))).first()[:] == (50, 300)
    wanted = job.parse_messages(spark.read.schema(RAW_MESSAGES).json(f"{runner.root}/log"))
    wanted = wanted.dropDuplicates(["event_id"]).drop("kafka_partition", "kafka_offset")
    got = flagged.where("copies = 0").drop("copies", "kafka_partition", "kafka_offset")
    assert got.exceptAll(wanted).isEmpty() and got.count() == wanted.count() == 300
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 50


def test_a_micro_batch_is_staged_as_files_not_held_in_memory(runner):
    """Nothing is cached while a micro-batch is stored, and nothing of it is staged afterwards."""
    cached, staged = [], []

    def sink(letters, batch_id):
        cached.append(runner.spark.sparkContext._jsc.getPersistentRDDs().size())
        staged.extend(p.name for p in (Path(runner.root) / "store" / "staging" / str(batch_id)).iterdir())
        letters.write.parquet(f"{runner.root}/letters")

    early = message(timestamp="0001-01-01T00:00:00+00:00", event=5)  # no time that Parquet takes
    same = message(anonymous_id="anon-1")
    runner.send(same, same, b"{broken", early)
    raw = read_raw_stream(runner.spark, path=f"{runner.root}/log")
    job.start_stream(raw, runner.store, dedup=runner.dedup, available_now=True, letter_sink=sink).awaitTermination()
    assert cached == [0]
    assert sorted(staged) == (["parsed", "rows"] if runner.dedup == "exact" else ["parsed"])
    assert not list((Path(runner.root) / "store" / "staging").iterdir())
    assert runner.rows().count() == 1 and runner.spark.read.parquet(f"{runner.root}/letters").count() == 2
    assert runner.report(consumed=4) == [(4, 1, 1, 2)]


def test_ids_of_the_state_store_are_on_disk_whatever_the_session_says(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.unset(provider)  # Spark's default has them on the heap
    try:
        runner = Runner(spark, str(tmp_path), "state")
        same = message()
        runner.send(same, same)
        runner.run()
        runner.send(same, message())
        progress = runner.run().lastProgress
    finally:
        spark.conf.set(provider, before)
    assert any("rocksdb" in name for name in progress.stateOperators[0].customMetrics)
    assert runner.rows().count() == 2 and runner.report(consumed=4) == [(2, 1, 1, 0), (2, 1, 1, 0)]
