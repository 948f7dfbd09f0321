from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime, timedelta

import pytest
from rows import PROJECT
from pyspark.sql import functions as F

from footfall.functions.scalars import canonical_uuid
from footfall.operators.ingest import (
    assign_partition,
    batch_sizes,
    corrected_timestamp,
    explode_batches,
    ingest,
    validate,
)
from footfall.operators.quota import batch_costs, quota_usage
from footfall.operators.tracking_plan import parse_plans
from footfall.schemas import RAW_BATCHES

RECEIVED = datetime(2026, 1, 1, 12, tzinfo=UTC)
# A weather station's readings.
PLAN = {
    "events": {
        "reading": {
            "properties": {
                "site": {"type": "string", "required": True, "enum": ["hill", "pier"]},
                "celsius": {"type": "number", "required": True},
            },
            "additional_properties": False,
        }
    }
}


def reading(**properties):
    return item(event="reading", properties=properties)


def item(**given) -> dict:
    base = {
        "event_id": str(uuid.uuid4()),
        "event": "page_viewed",
        "anonymous_id": "browser-58",
        "properties": {"path": "/tides"},
    }
    return {k: v for k, v in (base | given).items() if v is not ...}


@pytest.fixture
def batches(spark):
    def make(*groups, project=PROJECT, sent_at=None):
        rows = []
        for number, group in enumerate(groups):
            texts = [i if isinstance(i, str) else json.dumps(i) for i in group]
            rows.append((f"b{number}", project, RECEIVED, "10.0.0.1", sent_at, texts))
        return spark.createDataFrame(rows, RAW_BATCHES)

    return make


@pytest.fixture
def plans(spark):
    def make(*versions, project=PROJECT):
        rows = [(project, n, json.dumps(plan)) for n, plan in enumerate(versions, 1)]
        return parse_plans(spark.createDataFrame(rows, "project_id string, version int, plan string"))

    return make


def errors_of(batches, *items):
    rows = validate(explode_batches(batches(list(items)))).orderBy("index").collect()
    return [r["errors"] for r in rows]


def test_a_batch_keeps_its_good_items_and_names_the_others(batches):
    nobody = item(anonymous_id=...)
    result = ingest(batches([item(colour="red"), item(user_id="u-9"), nobody, item(), item(event="")]))
    assert {r["index"] for r in result.accepted.collect()} == {1, 3}
    rejected = {r["index"]: (r["event_id"], r["errors"][0]) for r in result.rejected.collect()}
    assert set(rejected) == {0, 2, 4}
    assert rejected[0][1].startswith("colour: ") and rejected[4][1].startswith("event: ")
    assert rejected[2][0] == nobody["event_id"] and "user_id or anonymous_id" in rejected[2][1]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, []),
        ({"event_id": ...}, ["event_id: Field required"]),
        ({"event_id": "nope"}, ["event_id: Input should be a valid UUID"]),
        ({"event_id": 5}, ["event_id: UUID input should be a string, bytes or UUID object"]),
        ({"event": ""}, ["event: String should have at least 1 character"]),
        ({"event": "x" * 129}, ["event: String should have at most 128 characters"]),
        ({"event": "é" * 128}, []),
        ({"event": None}, ["event: Input should be a valid string"]),
        ({"user_id": None}, []),
        ({"user_id": ""}, ["user_id: String should have at least 1 character"]),
        ({"anonymous_id": "x" * 256}, ["anonymous_id: String should have at most 255 characters"]),
        ({"anonymous_id": 7}, ["anonymous_id: Input should be a valid string"]),
        ({"timestamp": "2026-01-01T10:00:00Z"}, []),
        ({"timestamp": "2026-01-01T10:00:00.123456+05:30"}, []),
        ({"timestamp": 1767261600}, []),
        ({"timestamp": None}, []),
        ({"timestamp": "2026-01-01T10:00:00"}, ["timestamp: Input should have timezone info"]),
        ({"timestamp": "yesterday"}, ["timestamp: Input should be a valid datetime"]),
        ({"timestamp": "2026-13-01T10:00:00Z"}, ["timestamp: Input should be a valid datetime"]),
        ({"properties": None}, ["properties: Input should be a valid dictionary"]),
        ({"context": [1]}, ["context: Input should be a valid dictionary"]),
        ({"properties": ...}, []),
        (
            {"event": "", "zeta": 1, "alpha": 2},
            [
                "event: String should have at least 1 character",
                "zeta: Extra inputs are not permitted",
                "alpha: Extra inputs are not permitted",
            ],
        ),
        (
            {"anonymous_id": ..., "event": 3},  # field errors come alone
            ["event: Input should be a valid string"],
        ),
        (
            {"properties": {"blob": "x" * 32_001}},
            ["event: Value error, properties exceed 32000 bytes"],
        ),
        ({"properties": {"blob": "x" * (32_000 - 11)}}, []),
    ],
)
def test_validation(batches, change, expected):
    assert errors_of(batches, item(**change)) == [expected]


def test_uuid_forms(spark):
    plain = "0123456789ABCDEF0123456789abcdef"
    wanted = "01234567-89ab-cdef-0123-456789abcdef"
    texts = [plain, wanted, f"{{{wanted}}}", f"urn:uuid:{wanted}", wanted[:-1], f"{{{wanted}", "x" + plain]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(canonical_uuid(F.col("t"))).collect()]
    assert got == [wanted] * 4 + [None] * 3


def test_batch_admission(batches):
    groups = ([item()] * 3, [item()] * 2, [], ["[1]", item()], [{"event": "x"}])
    result = ingest(batches(*groups), max_events=2)
    status = {r["batch_id"]: (r["status"], r["accepted"], r["rejected"]) for r in result.batch_results().collect()}
    assert status == {
        "b0": ("batch_too_large", 0, 0),
        "b1": ("accepted", 2, 0),
        "b2": ("invalid_batch", 0, 0),
        "b3": ("invalid_batch", 0, 0),
        "b4": ("no_valid_events", 0, 1),
    }
    counts = {r["outcome"]: r["events"] for r in result.outcome_counts().collect()}
    assert counts == {"refused": 5, "accepted": 2, "rejected_validation": 1}


def test_batches_over_quota(batches, spark):
    flagged = spark.createDataFrame([("b1", PROJECT), ("b0", "another project")], "batch_id string, project_id string")
    result = ingest(batches([item()], [item()] * 2), over_quota=flagged)
    counts = {r["outcome"]: r["events"] for r in result.outcome_counts().collect()}
    assert counts == {"accepted": 1, "rejected_quota": 2}
    other = ingest(batches([item()], project="another project"), over_quota=flagged)
    assert [r["status"] for r in other.batch_results().collect()] == ["quota_exceeded"]


def test_size_histogram(batches):
    sized = batch_sizes(batches([item()], [item()] * 5, [item()] * 6, [item()] * 501)).collect()
    assert {r["edge"]: (r["batches"], r["events"]) for r in sized} == {
        1.0: (1, 1), 5.0: (1, 5), 10.0: (1, 6), float("inf"): (1, 501),
    }


@pytest.mark.parametrize(
    ("client", "sent", "expected"),
    [
        (None, None, RECEIVED),
        (
            RECEIVED + timedelta(hours=2, seconds=-30),
            RECEIVED + timedelta(hours=2),
            RECEIVED - timedelta(seconds=30),
        ),
        (RECEIVED - timedelta(minutes=3), None, RECEIVED - timedelta(minutes=3)),
        (RECEIVED + timedelta(days=1), None, RECEIVED),
        (RECEIVED + timedelta(seconds=10), None, RECEIVED + timedelta(seconds=10)),
        (RECEIVED + timedelta(seconds=60), None, RECEIVED + timedelta(seconds=60)),
        (RECEIVED + timedelta(seconds=61), None, RECEIVED),
    ],
)
def test_clock_correction(spark, client, sent, expected):
    rows = spark.createDataFrame([(client, sent, RECEIVED)], "c timestamp, s timestamp, r timestamp")
    got = rows.select(F.unix_micros(corrected_timestamp("c", "s", "r"))).first()[0]
    assert got == int(expected.timestamp() * 1_000_000)


def test_messages(batches):
    happened = RECEIVED - timedelta(hours=1, seconds=5)
    sent = RECEIVED - timedelta(hours=1)
    signup = item(event="signup", user_id="u-42", timestamp=happened.isoformat())
    result = ingest(batches([signup, item()], sent_at=sent))
    messages = [(bytes(r["key"]).decode(), json.loads(bytes(r["value"]))) for r in result.messages().collect()]
    by_name = {m["event"]: (key, m) for key, m in messages}
    key, message = by_name["signup"]
    assert key == f"{PROJECT}:u-42"
    assert message == {
        "schema_version": 1,
        "project_id": PROJECT,
        "event_id": signup["event_id"],
        "event": "signup",
        "distinct_id": "u-42",
        "user_id": "u-42",
        "anonymous_id": "browser-58",
        "timestamp": "2026-01-01T11:59:55.000000+00:00",
        "client_timestamp": "2026-01-01T10:59:55.000000+00:00",
        "sent_at": "2026-01-01T11:00:00.000000+00:00",
        "received_at": "2026-01-01T12:00:00.000000+00:00",
        "ip": "10.0.0.1",
        "properties": {"path": "/tides"},
        "context": {},
        "violations": [],
    }
    assert by_name["page_viewed"][0] == f"{PROJECT}:browser-58"
    assert by_name["page_viewed"][1]["user_id"] is None


def test_users_stay_on_one_partition(batches):
    result = ingest(batches([item(anonymous_id=f"user-{i % 3}") for i in range(12)]))
    placed = assign_partition(result.messages(), 6).groupBy("distinct_id")
    assert [r[1] for r in placed.agg(F.count_distinct("partition")).collect()] == [1, 1, 1]


def test_a_warning_plan_lets_faults_through_and_lists_them(batches, plans):
    sent = [reading(site="pier", celsius=-4.5), reading(site="roof", celsius=1, wind=3), reading(celsius=None), item()]
    rows = ingest(batches(sent), plans(PLAN)).accepted.orderBy("index").collect()
    assert [r["violations"] for r in rows] == [
        [],
        ["value_not_allowed:site", "unexpected_property:wind"],
        ["missing_required:site", "wrong_type:celsius:expected_number"],
        [],
    ]


def test_a_blocking_plan_refuses_faults_by_its_newest_version(batches, plans):
    sent = [reading(site="hill"), reading(site="hill", celsius=20), item(event=7), item()]
    result = ingest(batches(sent), plans(PLAN, PLAN | {"enforcement": "block"}))
    assert {r["index"] for r in result.accepted.collect()} == {1, 3}
    errors = {r["index"]: r["errors"] for r in result.rejected.collect()}
    assert set(errors) == {0, 2} and errors[0] == ["tracking_plan: missing_required:celsius"]


def test_plans_join_alike_without_broadcast(spark, batches, plans):
    sent = [reading(site=s, celsius=k) for k, s in enumerate(["pier", "moon", "hill"] * 40)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = ingest(batches(sent), plans(PLAN)).accepted.orderBy("index").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [len(r["violations"]) for r in rows] == [0, 1, 0] * 40


def bucket_depths(charges, rate):
    """Level of a leaking bucket after each charge, walked through in order."""
    depth, last, found = 0.0, None, []
    for moment, cost in charges:
        if last is not None:
            depth = max(0.0, depth - (moment - last).total_seconds() * rate)
        depth, last = depth + cost, moment
        found.append(round(depth, 3))
    return found


def test_quota_is_charged_per_event_and_per_project(spark):
    import random

    rng = random.Random(5)
    rows, expected = [], {}
    for project in ("p", "q"):
        moment, charges = RECEIVED, []
        for number in range(120):
            moment += timedelta(milliseconds=rng.choice([0, 500, 20_000, 200_000]))
            cost = rng.randint(1, 40)
            charges.append((moment, cost))
            rows.append((project, f"{project}{number:04}", moment, cost))
        for number, depth in enumerate(bucket_depths(charges, 0.25)):
            expected[f"{project}{number:04}"] = depth
    costs = spark.createDataFrame(rows, "project_id string, batch_id string, received_at timestamp, cost bigint")
    usage = quota_usage(costs, rate=0.25, burst=50).collect()
    assert {r["batch_id"]: r["depth"] for r in usage} == pytest.approx(expected, abs=2e-3)
    assert all(r["exceeded"] == (r["depth"] > 50) for r in usage)


def test_a_batch_larger_than_the_burst_exceeds_it(batches):
    usage = quota_usage(batch_costs(batches([item()] * 10, [item()])), rate=0.001, burst=10).collect()
    assert [r["exceeded"] for r in sorted(usage, key=lambda r: r["batch_id"])] == [False, True]


def test_zoned_timestamps(spark):
    from footfall.functions.scalars import zoned_timestamp

    same = int(datetime(2026, 1, 1, 10, 0, 0, 500_000, tzinfo=UTC).timestamp() * 1_000_000)
    forms = [
        "2026-01-01T10:00:00.5Z", "2026-01-01t10:00:00.5z", "2026-01-01 10:00:00.500+00:00",
        "2026-01-01_10:00:00.5Z", "2026-01-01T15:30:00.5+0530", "2026-01-01T05:00:00.5-05:00",
    ]
    wrong = ["2026-01-01T10:00:00", "2026-01-01Z", "2026-02-30T10:00:00Z", "x", ""]
    rows = spark.createDataFrame([(t,) for t in forms + wrong + ["2026-01-01T10:00Z"]], "t string")
    got = [r[0] for r in rows.select(F.unix_micros(zoned_timestamp(F.col("t")))).collect()]
    assert got == [same] * len(forms) + [None] * len(wrong) + [same - 500_000]
