"""Registered queries: one per operator, each over the driver's tables, most with a SQL twin.

A query is registered with the SQL that gives the same rows. The SQL starts from the native
columns of the tables (never from the JSON the Spark side builds and parses).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.props import Properties, matches_all
from footfall.functions.scalars import rate
from footfall.functions.timebuckets import bucket, bucket_spine
from footfall.operators import (
    dedup,
    funnel,
    identity,
    ingest,
    listings,
    quota,
    reports,
    retention,
    scope,
    segmentation,
    sessions,
    tracking_plan,
)
from footfall.plans.requests import (
    FunnelQuery,
    FunnelStep,
    ListingQuery,
    PropertyFilter,
    RetentionQuery,
    SegmentationQuery,
    SessionsQuery,
)
from footfall.session import shared_dir
from footfall.sources import events as event_table
from footfall.sources import links as link_table
from footfall.sources import generate, raw_topic, sample
from footfall.streaming import job
from footfall.streaming.messages import dead_letters, event_rows, parse_messages

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        @functools.wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return query(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def day(number: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(days=number - 1, hours=hour)


P0 = sample.PROJECT

# --- SQL side of the adapter ---------------------------------------------------------------

RAW = """
raw AS (
    SELECT event_id AS id, user_id AS uid, event_type AS event, value,
           date_trunc('millisecond', ts) AS t0,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
           CASE WHEN user_id % 10 = 9 THEN 'p1' ELSE 'p0' END AS project_id,
           CASE WHEN user_id % 3 <> 2 THEN 'anon-' || CAST(user_id // 2 AS VARCHAR) END AS anonymous_id,
           CASE WHEN event_type IN ('view', 'click') AND event_id % 2 = 0 AND user_id % 3 <> 2
                THEN NULL ELSE 'u-' || CAST(user_id AS VARCHAR) END AS user_id,
           CASE event_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'team' END AS plan,
           lpad(CAST(event_id % 100000000 AS VARCHAR), 8, '0') || '-0000-4000-8000-'
               || lpad(CAST(event_id // 100000000 AS VARCHAR), 12, '0') AS event_id,
           '00000000-0000-4000-8000-00000000000'
               || CASE WHEN user_id % 10 = 9 THEN '1' ELSE '0' END AS project_uuid
    FROM events
)"""

EV = f"""
WITH {RAW},
ev AS (
    SELECT raw.*, coalesce(user_id, anonymous_id) AS distinct_id, copy,
           t0 + copy * INTERVAL 500 MILLISECOND AS ts,
           t0 AS received_at,
           t0 + (id % 400 + copy) * INTERVAL 1 SECOND AS ingested_at
    FROM (SELECT *, unnest(CASE WHEN id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM raw) AS raw
),
cur AS (
    SELECT * FROM ev
    QUALIFY row_number() OVER (
        PARTITION BY project_id, id, event, distinct_id, CAST(ts AS DATE)
        ORDER BY ingested_at DESC) = 1
),
firsts AS (
    SELECT project_id, anonymous_id, user_id AS linked_user FROM ev
    WHERE anonymous_id IS NOT NULL AND user_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY project_id, anonymous_id ORDER BY ts, user_id) = 1
),
people AS (
    SELECT cur.*, coalesce(cur.user_id, firsts.linked_user, cur.distinct_id) AS person_id
    FROM cur LEFT JOIN firsts
      ON cur.project_id = firsts.project_id AND cur.anonymous_id = firsts.anonymous_id
)"""

VIOLATIONS = """concat_ws('|', CASE WHEN id % 4 = 3 THEN 'missing_required:plan' END,
                 CASE WHEN k >= 90 THEN 'value_not_allowed:k' END)"""

_STORES: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]) -> object:
    """Tables several queries read are written once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _STORES:
        _STORES[key] = make()
    return _STORES[key]


def _new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


# --- Sources and sinks ----------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, mode: str = "exact") -> job.Store:
    """The stream job run to the end over the derived log."""

    def run() -> job.Store:
        root = _new_dir(spark, "stream")
        sample.raw_messages(spark, sf_dir).write.parquet(f"{root}/raw")
        store = job.Store(root)
        raw = raw_topic.read_raw_stream(spark, path=f"{root}/raw", file_format="parquet")
        query = job.start_stream(raw, store, dedup=mode, available_now=True)
        query.awaitTermination()
        return store

    return _once(spark, sf_dir, f"stream-{mode}", run)


LOG = f"""
WITH {RAW},
log AS (
    SELECT raw.*, copy, t0 + copy * INTERVAL 500 MILLISECOND AS ts,
           CAST(id % 6 AS INTEGER) AS kafka_partition, id // 6 + copy * 1000000000 AS kafka_offset,
           coalesce(user_id, anonymous_id) AS distinct_id,
           CASE WHEN id % 23 = 1 THEN 'invalid_json'
                WHEN id % 29 = 4 THEN 'not_an_object'
                WHEN id % 31 = 2 THEN 'unsupported_schema_version:7'
                WHEN id % 37 = 3 THEN 'invalid_message:event_id:Input should be a valid UUID'
           END AS reason
    FROM (SELECT *, unnest(CASE WHEN id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM raw) AS raw
)"""


@register(
    "s1_raw_stream",
    LOG + """
    SELECT topic, partition, count(*) AS records, min("offset") AS first_offset, max("offset") AS last_offset
    FROM (SELECT 'events.raw' AS topic, kafka_partition AS partition, kafka_offset AS "offset" FROM log)
    GROUP BY ALL""",
)
def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _new_dir(spark, "raw")
    sample.raw_messages(spark, sf_dir).write.json(f"{root}/log")
    stream = raw_topic.read_raw_stream(spark, path=f"{root}/log", file_format="json", max_files=4)
    copy = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/copy")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    copy.awaitTermination()
    return spark.read.parquet(f"{root}/copy").groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
    )


STORED_COLUMNS = [
    "project_id",
    "event_id",
    "event",
    "distinct_id",
    "user_id",
    "anonymous_id",
    "timestamp",
    "kafka_partition",
    "kafka_offset",
]


@register(
    "s2_events_sink",
    LOG + """
    SELECT project_uuid AS project_id, event_id, event, distinct_id, user_id, anonymous_id,
           ts AS timestamp, kafka_partition, kafka_offset, strftime(ts, '%Y%m') AS month
    FROM log WHERE reason IS NULL AND copy = 0""",
)
def events_sink(spark: SparkSession, sf_dir: str, mode: str = "exact") -> DataFrame:
    stored = event_table.scan_events(spark, _streamed(spark, sf_dir, mode).events)
    return stored.select(*STORED_COLUMNS, "month")


@register(
    "s3_dead_letter_sink",
    LOG + """
    SELECT reason, 'events.raw' AS source_topic, kafka_partition AS source_partition,
           kafka_offset AS source_offset, project_uuid || ':' || distinct_id AS message_key,
           CASE WHEN reason = 'invalid_json' THEN '{broken ' || event_id
                WHEN reason = 'not_an_object' THEN '[1, 2, 3]' END AS original
    FROM log WHERE reason IS NOT NULL""",
)
def dead_letter_sink(spark: SparkSession, sf_dir: str, mode: str = "exact") -> DataFrame:
    letters = job.stored_letters(spark, _streamed(spark, sf_dir, mode))
    shown = F.col("reason").isin("invalid_json", "not_an_object")
    return letters.select(
        "reason",
        "source_topic",
        "source_partition",
        "source_offset",
        F.col("key").cast("string").alias("message_key"),
        F.when(shown, F.col("value").cast("string")).alias("original"),
    )


def _events_table(spark: SparkSession, sf_dir: str) -> str:
    def write() -> str:
        path = _new_dir(spark, "events")
        event_table.load_events(sample.events(spark, sf_dir), path, "history")
        return path

    return _once(spark, sf_dir, "events", write)


@register(
    "s5_events_scan",
    EV + f"""
    SELECT project_id, event_id, event, distinct_id, user_id, anonymous_id, ts AS timestamp,
           received_at, ingested_at, {VIOLATIONS} AS violations
    FROM ev""",
)
def events_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table.scan_events(spark, _events_table(spark, sf_dir)).select(
        "project_id",
        "event_id",
        "event",
        "distinct_id",
        "user_id",
        "anonymous_id",
        "timestamp",
        "received_at",
        "ingested_at",
        F.array_join("violations", "|").alias("violations"),
    )


DEMO_START = datetime(2026, 6, 1, tzinfo=UTC)
DEMO_PROJECT = "demo"


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread while they are one number each: a user makes a dozen events."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n"))
    return users.repartition(sample.tasks_for(users), "n")


def _hash_sql(seed: str, salt: str, size: int) -> str:
    text = f"CAST({seed} AS VARCHAR) || ':{salt}'"
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {size})"


def _uuid_sql(text: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr(md5({text}), {at}, {size})" for at, size in cuts)


def _pick_sql(choices: tuple[str, ...], number: str) -> str:
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"([{listed}])[{number} + 1]"


def _demo_event_sql(event: str, nth: str, moment: str, properties: str, source: str) -> str:
    identity = f"'{DEMO_PROJECT}:' || {event} || ':' || n || ':' || {nth}"
    return f"""SELECT {_uuid_sql(identity)} AS event_id, {event} AS event,
        'user-' || n AS distinct_id, {moment} AS timestamp, {properties} AS properties FROM {source}"""


DEMO_USERS = f"""users AS (
    SELECT c_custkey AS n, TIMESTAMP '2026-06-01 00:00:00'
        + to_seconds({_hash_sql("c_custkey", "signup", generate.SIGNUP_SPREAD_SECONDS)}) AS signup
    FROM customer)"""
_VIEW_SEED = "(n || ':' || i)"
_WEEK_SEED = "(n || ':' || week)"
DEMO_SQL = {
    "signups": _demo_event_sql(
        "'signup'",
        "'0'",
        "signup",
        f"""'{{"plan":"' || {_pick_sql(generate.PLANS, _hash_sql("n", "plan", 4))} || '"}}'""",
        "users",
    ),
    "page_views": _demo_event_sql(
        "'page_viewed'",
        "'view-' || i",
        f"signup + to_seconds({_hash_sql(_VIEW_SEED, 'pv', 172_800)})",
        f"""'{{"path":"' || {_pick_sql(generate.PATHS, _hash_sql(_VIEW_SEED, "path", 4))} || '"}}'""",
        f"(SELECT *, unnest(range({_hash_sql('n', 'views', 20)})) AS i FROM users)",
    ),
    "funnel_steps": _demo_event_sql(
        "'checkout_started'",
        "'0'",
        f"signup + to_seconds({_hash_sql('n', 'co', 82_800)} + 3600)",
        "'{}'",
        f"users WHERE {_hash_sql('n', 'p_co', 100)} < 40",
    )
    + " UNION ALL "
    + _demo_event_sql(
        "'purchase'",
        "'0'",
        f"signup + to_seconds({_hash_sql('n', 'pu', 14_400)} + 90000)",
        f"""'{{"value":' || ({_hash_sql("n", "val", 491)} + 9) || '}}'""",
        f"users WHERE {_hash_sql('n', 'p_co', 100)} < 40 AND {_hash_sql('n', 'p_pu', 100)} < 55",
    ),
    "return_visits": _demo_event_sql(
        "'page_viewed'",
        "'week-' || week",
        f"signup + to_seconds(week * 604800 + {_hash_sql(_WEEK_SEED, 'visit', 604_800)})",
        "'{\"path\":\"/app\"}'",
        f"""(SELECT *, unnest(range(1, 9)) AS week FROM users)
            WHERE {_hash_sql(_WEEK_SEED, 'ret', 100)} < 45 - week * 5""",
    ),
}


@register(
    "s6_month_drop",
    f"WITH {DEMO_USERS}, made AS ("
    + " UNION ALL ".join(DEMO_SQL.values())
    + """) SELECT strftime(timestamp, '%Y%m') AS month, count(*) AS rows FROM made
    WHERE timestamp >= TIMESTAMP '2026-07-01' GROUP BY ALL""",
)
def month_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_dir(spark, "demo")
    made = generate.demo_events(_users(spark, sf_dir), DEMO_PROJECT, DEMO_START)
    event_table.load_events(made, path, "demo")
    event_table.drop_months_before(spark, path, "202607")
    stored = event_table.scan_events(spark, path)
    return stored.groupBy("month").agg(F.count(F.lit(1)).alias("rows"))


def _register_generators() -> None:
    for number, part in enumerate(("signups", "page_views", "funnel_steps", "return_visits"), 7):

        def made(spark: SparkSession, sf_dir: str, part: str = part) -> DataFrame:
            rows = getattr(generate, part)(_users(spark, sf_dir), DEMO_PROJECT, DEMO_START)
            return rows.select("event_id", "event", "distinct_id", "timestamp", "properties")

        register(f"s{number}_demo_{part}", f"WITH {DEMO_USERS} {DEMO_SQL[part]}")(made)


_register_generators()


@register(
    "s11_load_batches",
    f"""SELECT 'load-' || (o_orderkey // 100) AS batch_id,
           {_uuid_sql("'demo:load:' || o_orderkey")} AS event_id,
           {_pick_sql(generate.BATCH_NAMES, _hash_sql("o_orderkey", "name", 6))} AS event,
           'user-' || {_hash_sql("o_orderkey", "user", 1000)} AS user_id,
           {_pick_sql(generate.BATCH_PATHS, "(o_orderkey % 100 % 5)")} AS path,
           CAST(o_orderkey % 100 AS BIGINT) AS value
    FROM orders""",
)
def load_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("n"))
    batches = generate.load_batches(orders, DEMO_PROJECT, DEMO_START)
    items = batches.select("batch_id", F.explode("batch").alias("item"))
    schema = "event_id string, event string, user_id string, properties struct<path string, value bigint>"
    parsed = items.select("batch_id", F.from_json("item", schema).alias("e"))
    return parsed.select("batch_id", "e.event_id", "e.event", "e.user_id", "e.properties.*")


@register(
    "s12_project_rows",
    EV + " SELECT count(*) AS rows FROM ev WHERE project_id = 'p0'",
)
def project_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.project_row_count(sample.events(spark, sf_dir), P0)


# --- Ingestion ------------------------------------------------------------------------------

MAX_BATCH = 24
ITEMS = f"""
WITH {RAW},
placed AS (
    SELECT *, right(project_uuid, 1) || '/b-' || CAST(id // 25 AS VARCHAR) AS batch_id,
           CAST(row_number() OVER batch - 1 AS INTEGER) AS index,
           count(*) OVER whole AS batch_size,
           max(t0) OVER whole + INTERVAL 5 SECOND AS received_at,
           (id // 25) % 3 <> 0 AS measured
    FROM raw
    WINDOW batch AS (PARTITION BY project_id, id // 25 ORDER BY id),
           whole AS (PARTITION BY project_id, id // 25)
),
timed AS (
    SELECT *, CASE WHEN id % 7 = 0 THEN NULL
                   WHEN measured THEN t0 + INTERVAL 2 HOUR
                   WHEN id % 11 = 0 THEN t0 + INTERVAL 1 DAY
                   ELSE t0 END AS client,
           CASE WHEN measured THEN received_at + INTERVAL 2 HOUR END AS sent_at
    FROM placed
),
faulty AS (
    SELECT *, nullif(concat_ws('|',
               CASE WHEN id % 43 = 1 THEN 'event_id: Input should be a valid UUID' END,
               CASE WHEN id % 59 = 4 THEN 'event: String should have at least 1 character' END,
               CASE WHEN id % 53 = 3 AND client IS NOT NULL
                    THEN 'timestamp: Input should have timezone info' END,
               CASE WHEN id % 61 = 5 AND id % 41 <> 0
                    THEN 'properties: Input should be a valid dictionary' END,
               CASE WHEN id % 41 = 0 THEN 'propertes: Extra inputs are not permitted' END), '') AS fields
    FROM timed
),
checked AS (
    SELECT *, coalesce(fields,
               CASE WHEN id % 47 = 2
                    THEN 'event: Value error, one of user_id or anonymous_id is required'
                    WHEN id % 67 = 6 AND id % 41 <> 0
                    THEN 'event: Value error, properties exceed 32000 bytes' END, '') AS errors,
           CASE WHEN id % 43 = 1 THEN 'not-a-uuid' ELSE event_id END AS given_event_id,
           CASE WHEN batch_size > {MAX_BATCH} THEN 'batch_too_large' END AS refusal,
           CASE WHEN client IS NULL THEN received_at
                WHEN measured THEN t0
                WHEN client > received_at + INTERVAL 60 SECOND THEN received_at
                ELSE client END AS corrected
    FROM faulty
),
planned AS (
    SELECT *, CASE WHEN errors <> '' THEN NULL
                   WHEN event = 'purchase' THEN concat_ws('|',
                       CASE WHEN id % 4 = 3 THEN 'missing_required:plan' END,
                       CASE WHEN id % 4 = 2 THEN 'value_not_allowed:plan' END)
                   WHEN event = 'click' THEN concat_ws('|', 'wrong_type:value:expected_string',
                       CASE WHEN id % 4 <> 3 THEN 'unexpected_property:plan' END)
                   WHEN project_id = 'p0' THEN 'unplanned_event'
                   ELSE '' END AS violations
    FROM checked
),
routed AS (
    SELECT *, CASE WHEN refusal IS NOT NULL THEN 'refused'
                   WHEN errors <> '' THEN 'rejected_validation'
                   WHEN project_id = 'p0' AND violations <> '' THEN 'rejected_plan'
                   ELSE 'accepted' END AS outcome
    FROM planned
)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.explode_batches(sample.raw_batches(spark, sf_dir), MAX_BATCH)


def _ingested(spark: SparkSession, sf_dir: str) -> ingest.Ingested:
    plans = sample.tracking_plans(spark, sf_dir)
    return ingest.ingest(sample.raw_batches(spark, sf_dir), plans, max_events=MAX_BATCH)


@register(
    "i1_explode_batches",
    ITEMS + """ SELECT batch_id, project_uuid AS project_id, index, CAST(batch_size AS INTEGER) AS batch_size,
               CASE WHEN id % 43 = 1 THEN 'not-a-uuid' ELSE event_id END AS event_id FROM placed""",
)
def explode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = sample.raw_batches(spark, sf_dir)
    return ingest.explode_batches(batches).select(
        "batch_id",
        "project_id",
        "index",
        "batch_size",
        F.regexp_extract("item", '"event_id":"([^"]*)"', 1).alias("event_id"),
    )


@register(
    "i2_validate",
    ITEMS + " SELECT batch_id, index, given_event_id, errors FROM checked",
)
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate(_items(spark, sf_dir)).select(
        "batch_id", "index", "given_event_id", F.array_join("errors", "|").alias("errors")
    )


@register(
    "i3_distinct_id",
    EV + " SELECT event_id, copy, coalesce(user_id, anonymous_id, '') AS distinct_id FROM ev",
)
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.events(spark, sf_dir)
    copy = F.expr(f"cast(kafka_offset div {sample.COPY_OFFSET} as int)").alias("copy")
    return rows.select("event_id", copy, ingest.distinct_id().alias("distinct_id"))


@register(
    "i4_clock_skew",
    ITEMS + " SELECT batch_id, index, corrected AS timestamp FROM checked WHERE errors = ''",
)
def clock_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = ingest.validate(_items(spark, sf_dir)).filter(F.size("errors") == 0)
    corrected = ingest.corrected_timestamp("client_timestamp", "sent_at", "received_at")
    return valid.select("batch_id", "index", corrected.alias("timestamp"))


@register(
    "i5_violations",
    ITEMS + " SELECT batch_id, index, violations FROM planned WHERE errors = ''",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _ingested(spark, sf_dir).items
    # Errors of the plan come on top of none from validation.
    valid = items.filter((F.size("errors") == 0) | F.col("errors")[0].startswith("tracking_plan: "))
    return valid.select("batch_id", "index", F.array_join("violations", "|").alias("violations"))


@register(
    "i6_routing",
    ITEMS + """ SELECT batch_id, project_uuid AS project_id, index, given_event_id AS event_id,
               CASE WHEN outcome = 'rejected_plan'
                    THEN 'tracking_plan: ' || replace(violations, '|', '|tracking_plan: ')
                    ELSE errors END AS errors
               FROM routed WHERE outcome IN ('rejected_validation', 'rejected_plan')""",
)
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _ingested(spark, sf_dir).rejected
    return rejected.withColumn("errors", F.array_join("errors", "|"))


@register(
    "i7_batch_admission",
    ITEMS + """ SELECT batch_id, project_uuid AS project_id,
               coalesce(max(refusal), CASE WHEN count(*) FILTER (outcome = 'accepted') = 0
                        THEN 'no_valid_events' ELSE 'accepted' END) AS status,
               count(*) FILTER (outcome = 'accepted') AS accepted,
               count(*) FILTER (outcome IN ('rejected_validation', 'rejected_plan')) AS rejected
               FROM routed GROUP BY batch_id, project_uuid""",
)
def batch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).batch_results()


MESSAGE_SQL = ITEMS + """
    SELECT project_uuid || ':' || coalesce(user_id, anonymous_id) AS message_key, event_id,
           event, user_id, anonymous_id,
           strftime(corrected, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp,
           strftime(client, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS client_timestamp,
           strftime(sent_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS sent_at,
           k, plan, violations, CAST(1 AS INTEGER) AS schema_version
    FROM routed WHERE outcome = 'accepted'"""


def _opened_messages(messages: DataFrame) -> DataFrame:
    schema = (
        "schema_version int, event_id string, event string, user_id string, anonymous_id string,"
        " timestamp string, client_timestamp string, sent_at string,"
        " properties struct<k int, plan string>, violations array<string>"
    )
    opened = messages.select(
        F.col("key").cast("string").alias("message_key"),
        F.from_json(F.col("value").cast("string"), schema).alias("m"),
    )
    return opened.select(
        "message_key",
        *(f"m.{c}" for c in ("event_id", "event", "user_id", "anonymous_id", "timestamp")),
        "m.client_timestamp",
        "m.sent_at",
        "m.properties.k",
        "m.properties.plan",
        F.array_join("m.violations", "|").alias("violations"),
        "m.schema_version",
    )


@register("s4_message_writer", MESSAGE_SQL)
def message_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_dir(spark, "messages")
    raw_topic.write_messages(_ingested(spark, sf_dir).messages(), path=path, file_format="parquet")
    return _opened_messages(spark.read.parquet(path))


@register("i8_messages", MESSAGE_SQL)
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened_messages(_ingested(spark, sf_dir).messages())


@register(
    "i9_user_partitions",
    ITEMS + """ SELECT project_uuid AS project_id, coalesce(user_id, anonymous_id) AS distinct_id,
               count(*) AS messages, CAST(1 AS BIGINT) AS partitions
               FROM routed WHERE outcome = 'accepted' GROUP BY ALL""",
)
def user_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ingest.assign_partition(_ingested(spark, sf_dir).messages(), 6)
    return placed.groupBy("project_id", "distinct_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("partition").alias("partitions")
    )


@register(
    "i10_outcome_counts",
    ITEMS + " SELECT outcome, count(*) AS events FROM routed GROUP BY outcome",
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).outcome_counts()


def _edges_sql(value: str, edges: tuple[float, ...]) -> str:
    cases = " ".join(f"WHEN {value} <= {edge} THEN CAST({edge} AS DOUBLE)" for edge in edges)
    return f"CASE {cases} ELSE CAST('inf' AS DOUBLE) END"


@register(
    "i10_batch_sizes",
    ITEMS + f""", sized AS (SELECT batch_id, count(*) AS n FROM placed GROUP BY batch_id)
    SELECT {_edges_sql("n", ingest.limits.BATCH_SIZE_EDGES)} AS edge, count(*) AS batches,
           CAST(sum(n) AS BIGINT) AS events FROM sized GROUP BY 1""",
)
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.batch_sizes(sample.raw_batches(spark, sf_dir))


QUOTA = {"rate": 0.004, "burst": 60}


@register(
    "i11_quota_usage",
    ITEMS + f""",
    costs AS (SELECT project_uuid AS project_id, batch_id, received_at, count(*) AS cost
              FROM placed GROUP BY ALL),
    summed AS (SELECT *, sum(cost) OVER (PARTITION BY project_id ORDER BY received_at, batch_id
                   ROWS UNBOUNDED PRECEDING)
                   - (epoch_ms(received_at) - 1600000000000) / 1000.0::DOUBLE * {QUOTA["rate"]}::DOUBLE AS x
               FROM costs),
    deep AS (SELECT *, round(x - min(x - cost) OVER (PARTITION BY project_id
                   ORDER BY received_at, batch_id ROWS UNBOUNDED PRECEDING), 3) AS depth FROM summed)
    SELECT project_id, batch_id, received_at, cost, depth, depth > {QUOTA["burst"]} AS exceeded
    FROM deep""",
)
def quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.quota_usage(quota.batch_costs(sample.raw_batches(spark, sf_dir)), **QUOTA)


# --- Stream processing ----------------------------------------------------------------------


@register(
    "p1_parse_reasons",
    LOG + " SELECT kafka_partition, kafka_offset, reason FROM log",
)
def parse_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_messages(sample.raw_messages(spark, sf_dir))
    return parsed.select("kafka_partition", "kafka_offset", "reason")


@register(
    "p2_event_rows",
    LOG + """ SELECT project_uuid AS project_id, event_id, event, distinct_id, user_id, anonymous_id,
             ts AS timestamp, kafka_partition, kafka_offset, ts AS received_at, k, plan,
             CAST(0 AS INTEGER) AS violations FROM log WHERE reason IS NULL""",
)
def parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(parse_messages(sample.raw_messages(spark, sf_dir)))
    inside = F.from_json("properties", "k int, plan string")
    return rows.select(
        *STORED_COLUMNS,
        "received_at",
        inside.getField("k").alias("k"),
        inside.getField("plan").alias("plan"),
        F.size("violations").alias("violations"),
    )


@register(
    "p3_first_in_batch",
    EV + """ SELECT project_id, event_id, ts AS timestamp,
            id // 6 + copy * 1000000000 AS kafka_offset FROM ev WHERE copy = 0""",
)
def first_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.first_in_batch(sample.events(spark, sf_dir))
    return kept.select("project_id", "event_id", "timestamp", "kafka_offset")


@register(
    "p4_window_dedup",
    EV + """ SELECT project_id, event_id, ts AS timestamp FROM ev
            WHERE id NOT IN (SELECT id FROM ev WHERE copy = 0
                             AND ingested_at > TIMESTAMP '2024-01-19' AND ingested_at <= TIMESTAMP '2024-01-20')""",
)
def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.events(spark, sf_dir)
    stored = dedup.remembered_ids(dedup.first_in_batch(rows), "ingested_at")
    kept = dedup.drop_recently_stored(rows, stored, F.lit(day(20)))
    return kept.select("project_id", "event_id", "timestamp")


@register(
    "p4_stream_dedup",
    LOG + """ SELECT DISTINCT project_uuid AS project_id, event_id FROM log WHERE reason IS NULL""",
)
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _new_dir(spark, "dedup")
    sample.raw_messages(spark, sf_dir).write.parquet(f"{root}/raw")
    raw = raw_topic.read_raw_stream(spark, path=f"{root}/raw", file_format="parquet")
    store = job.Store(root)
    job.start_stream(raw, store, dedup="state", available_now=True).awaitTermination()
    return event_table.scan_events(spark, store.events).select("project_id", "event_id")


@register(
    "p5_latest_rows",
    EV + " SELECT project_id, event_id, event, distinct_id, ts AS timestamp, ingested_at FROM cur",
)
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.latest_rows(sample.events(spark, sf_dir)).select(
        "project_id", "event_id", "event", "distinct_id", "timestamp", "ingested_at"
    )


@register(
    "p6_compaction",
    EV + """ SELECT strftime(ts, '%Y%m') AS month, project_id, event, count(*) AS rows,
            max(ingested_at) AS newest FROM cur GROUP BY ALL""",
)
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_dir(spark, "compacted")
    rows = sample.events(spark, sf_dir)
    # Two writes that overlap, as a retry across micro-batches leaves them.
    event_table.write_events(rows, path, 0)
    event_table.write_events(rows, path, 1)
    for month in event_table.months(spark, path):
        event_table.compact_month(spark, path, month)
    stored = event_table.scan_events(spark, path)
    return stored.groupBy("month", "project_id", "event").agg(
        F.count(F.lit(1)).alias("rows"), F.max("ingested_at").alias("newest")
    )


LINKS_SQL = """ SELECT project_id, anonymous_id, user_id, min(ts) AS linked_at FROM ev
    WHERE anonymous_id IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL"""


@register("p7_identity_links", EV + LINKS_SQL)
def identity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identity_links(sample.events(spark, sf_dir))


@register("p8_links_upkeep", EV + LINKS_SQL)
def links_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.events(spark, sf_dir)
    half = F.lit(day(15))
    before = identity.identity_links(rows.filter(F.col("timestamp") < half))
    after = identity.identity_links(rows.filter(F.col("timestamp") >= half))
    return identity.merge_links(before, after, identity.identity_links(rows))


@register(
    "p9_stream_job",
    LOG + """, kept AS (SELECT * FROM log WHERE reason IS NULL AND copy = 0)
    SELECT project_uuid AS project_id, event, count(*) AS rows, count(DISTINCT distinct_id) AS ids,
           CAST(sum(k) AS BIGINT) AS k FROM kept GROUP BY ALL""",
)
def stream_job(spark: SparkSession, sf_dir: str, mode: str = "exact") -> DataFrame:
    stored = event_table.scan_events(spark, _streamed(spark, sf_dir, mode).events)
    k = F.from_json("properties", "k bigint").getField("k")
    return stored.groupBy("project_id", "event").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("distinct_id").alias("ids"),
        F.sum(k).alias("k"),
    )


@register(
    "p9_stream_links",
    LOG + """ SELECT project_uuid AS project_id, anonymous_id, user_id, min(ts) AS linked_at FROM log
    WHERE reason IS NULL AND copy = 0 AND anonymous_id IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL""",
)
def stream_links(spark: SparkSession, sf_dir: str, mode: str = "exact") -> DataFrame:
    return identity.merge_links(job.stored_links(spark, _streamed(spark, sf_dir, mode)))


@register(
    "p10_batch_report",
    LOG + """ SELECT count(*) AS consumed, count(*) FILTER (reason IS NULL AND copy = 0) AS inserted,
             count(*) FILTER (reason IS NULL AND copy = 1) AS duplicates,
             count(reason) AS dead_lettered FROM log""",
)
def batch_report(spark: SparkSession, sf_dir: str, mode: str = "exact") -> DataFrame:
    report = job.batch_report(spark, _streamed(spark, sf_dir, mode))
    names = ("consumed", "inserted", "duplicates", "dead_lettered")
    return report.agg(*(F.sum(name).alias(name) for name in names))


# The same with the ids in keyed state that forgets them after the window.
for _name, _query in {
    "s2_events_sink": events_sink,
    "s3_dead_letter_sink": dead_letter_sink,
    "p9_stream_job": stream_job,
    "p9_stream_links": stream_links,
    "p10_batch_report": batch_report,
}.items():
    register(f"{_name}_ttl", ORACLES[_name])(functools.partial(_query, mode="ttl"))


@register(
    "p11_backlog",
    EV + """, log AS (SELECT CAST(id % 6 AS INTEGER) AS partition, id // 6 AS "offset", ingested_at
                  FROM ev WHERE copy = 0),
    ends AS (SELECT partition, max("offset") + 1 AS stop FROM log GROUP BY partition),
    reached AS (SELECT partition, max("offset") + 1 AS position FROM log
           WHERE ingested_at < TIMESTAMP '2024-01-20' GROUP BY partition)
    SELECT 'events.raw' AS topic, partition, greatest(stop - coalesce(position, 0), 0) AS behind
    FROM ends LEFT JOIN reached USING (partition)""",
)
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dedup.first_in_batch(sample.events(spark, sf_dir)).select(
        F.lit("events.raw").alias("topic"),
        F.col("kafka_partition").alias("partition"),
        (F.col("kafka_offset") + 1).alias("next"),
        "ingested_at",
    )

    def highest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("topic", "partition").agg(F.max("next").alias("offset"))

    return reports.backlog(highest(log), highest(log.filter(F.col("ingested_at") < F.lit(day(20)))))


_FRESHNESS = EV + f""", delays AS (
    SELECT {_edges_sql("(epoch_us(ingested_at) - epoch_us(received_at)) / 1e6", reports.limits.FRESHNESS_EDGES)} AS edge
    FROM ev),
    counted AS (SELECT edge, count(*) AS n FROM delays GROUP BY edge),
    dense AS (SELECT e.edge, coalesce(n, 0) AS events,
                     CAST(sum(coalesce(n, 0)) OVER (ORDER BY e.edge) AS BIGINT) AS cumulative,
                     lag(e.edge, 1, 0.0::DOUBLE) OVER (ORDER BY e.edge) AS lower,
                     CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS total
              FROM (SELECT unnest([{", ".join(map(str, reports.limits.FRESHNESS_EDGES))}, 'inf'::DOUBLE]) AS edge) e
              LEFT JOIN counted USING (edge))"""


@register("p12_freshness", _FRESHNESS + " SELECT CAST(edge AS DOUBLE) AS edge, events, cumulative FROM dense")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.freshness_histogram(sample.events(spark, sf_dir))


@register(
    "p12_freshness_quantiles",
    _FRESHNESS + """ SELECT quantile, round(CASE WHEN isinf(edge) THEN lower
             ELSE lower + (edge - lower) * ((quantile * total - (cumulative - events)) / events) END, 6) AS seconds
    FROM dense, (SELECT unnest([0.5, 0.95, 0.99])::DOUBLE AS quantile)
    WHERE events > 0 AND cumulative >= quantile * total
    QUALIFY row_number() OVER (PARTITION BY quantile ORDER BY edge) = 1""",
)
def freshness_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.freshness_quantiles(sample.events(spark, sf_dir))
    return found.withColumn("seconds", F.round("seconds", 6))


@register(
    "p13_dead_letter_report",
    LOG + """ SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start,
             split_part(reason, ':', 1) AS reason, count(*) AS letters
    FROM log WHERE reason IS NOT NULL GROUP BY ALL""",
)
def dead_letter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sample.raw_messages(spark, sf_dir)
    letters = dead_letters(parse_messages(log))
    # The log of the driver's tables has no time of failure: the time of the event stands in.
    times = sample.events(spark, sf_dir).select(
        F.col("kafka_partition").alias("source_partition"),
        F.col("kafka_offset").alias("source_offset"),
        F.col("timestamp").alias("failed_at"),
    )
    return reports.dead_letter_report(letters.join(times, ["source_partition", "source_offset"]))


# --- Query building blocks --------------------------------------------------------------------


@register(
    "q1_base_filter",
    EV + """ SELECT event_id, event, ts AS timestamp FROM cur WHERE project_id = 'p0'
            AND ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-19 18:00:00'""",
)
def base_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scope.current_rows(sample.events(spark, sf_dir), P0, day(5, 6), day(19, 18))
    return rows.select("event_id", "event", "timestamp")


@register(
    "q2_persons",
    EV + " SELECT project_id, event_id, ts AS timestamp, person_id FROM people",
)
def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.events(spark, sf_dir)
    first = identity.first_links(identity.link_rows(rows))
    resolved = identity.with_person(dedup.latest_rows(rows), first, split_hot=True)
    return resolved.select("project_id", "event_id", "timestamp", "person_id")


@register(
    "q3_display_values",
    EV + """ SELECT event_id, ts AS timestamp, coalesce(plan, '') AS plan, CAST(k AS VARCHAR) AS k,
            '' AS missing FROM ev""",
)
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = Properties(["plan", "k", "missing"])
    shown = {name: inside.display(name) for name in inside.names}
    rows = sample.events(spark, sf_dir)
    return rows.select("event_id", "timestamp", *(c.alias(n) for n, c in shown.items()))


def _filter_counts(cases: dict[str, tuple[PropertyFilter, ...]]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dedup.latest_rows(sample.events(spark, sf_dir))
        counts = []
        for name, filters in cases.items():
            properties = Properties(f.property for f in filters)
            counts.append(F.count_if(matches_all(filters, properties)).alias(name))
        return rows.groupBy("project_id", "event").agg(*counts)

    return run


def _filter_sql(cases: dict[str, str]) -> str:
    counts = ", ".join(f"count(*) FILTER ({sql}) AS {name}" for name, sql in cases.items())
    return EV + f" SELECT project_id, event, {counts} FROM cur GROUP BY ALL"


HOSTILE = """x"]['plan' \\ $.plan` UNION SELECT 1 /*"""
FILTER_CASES: dict[str, dict[str, tuple[tuple, str]]] = {
    "q4_is_set": {"has_plan": ((("plan", "is_set"),), "plan IS NOT NULL")},
    "q5_is_not_set": {
        "no_plan": ((("plan", "is_not_set"),), "plan IS NULL"),
        "no_such": ((("nothing", "is_not_set"),), "true"),
    },
    "q6_equals": {
        "is_pro": ((("plan", "eq", "pro"),), "plan = 'pro'"),
        "k_is_7": ((("k", "eq", 7),), "k = 7"),
        "k_is_text": ((("k", "eq", "7"),), "false"),
        "k_is_true": ((("k", "eq", True),), "false"),
    },
    "q7_not_equals": {
        "not_pro": ((("plan", "neq", "pro"),), "plan <> 'pro'"),
        "k_not_7": ((("k", "neq", 7),), "k <> 7"),
        "k_not_text": ((("k", "neq", "7"),), "true"),
    },
    "q8_contains": {
        "has_r": ((("plan", "contains", "RE"),), "plan LIKE '%re%'"),
        "not_text": ((("k", "contains", "1"),), "false"),
    },
    "q9_ordering": {
        "above": ((("value", "gt", 100),), "value > 100"),
        "from": ((("k", "gte", 50),), "k >= 50"),
        "below": ((("value", "lt", 12.5),), "value < 12.5"),
        "up_to": ((("k", "lte", 10),), "k <= 10"),
        "text": ((("plan", "gte", 0),), "false"),
    },
    "q10_all_of": {
        "every": (
            (("plan", "eq", "pro"), ("value", "gt", 20), ("k", "lte", 80), ("x", "is_not_set")),
            "plan = 'pro' AND value > 20 AND k <= 80",
        ),
    },
    "q16_hostile_names": {
        "set": (((HOSTILE, "is_set"),), "false"),
        "equal": (((HOSTILE, "eq", HOSTILE),), "false"),
        "unset": (((HOSTILE, "is_not_set"),), "true"),
    },
}
for _name, _cases in FILTER_CASES.items():
    register(_name, _filter_sql({n: sql for n, (_, sql) in _cases.items()}))(
        _filter_counts(
            {n: tuple(PropertyFilter(*given) for given in filters) for n, (filters, _) in _cases.items()}
        )
    )


@register(
    "q12_time_buckets",
    EV + """ SELECT date_trunc('hour', ts) AS hour, date_trunc('day', ts)::TIMESTAMP AS day,
            date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS events FROM ev GROUP BY ALL""",
)
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [bucket("timestamp", interval).alias(interval) for interval in ("hour", "day", "week")]
    return sample.events(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))


@register(
    "q13_zero_fill",
    EV + """, spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-03 10:00:00',
                  TIMESTAMP '2024-01-20 09:00:00', INTERVAL 1 HOUR)) AS bucket),
    counted AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM ev
                WHERE event = 'signup' AND project_id = 'p1' GROUP BY 1)
    SELECT bucket, coalesce(n, 0) AS events FROM spine LEFT JOIN counted USING (bucket)""",
)
def zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.events(spark, sf_dir).filter("event = 'signup' and project_id = 'p1'")
    counts = rows.groupBy(bucket("timestamp", "hour").alias("bucket")).agg(
        F.count(F.lit(1)).alias("events")
    )
    start = day(3, 10) + timedelta(minutes=20)
    spine = bucket_spine(spark, start, day(20, 10), "hour")
    return spine.join(counts, "bucket", "left").fillna(0, ["events"])


@register(
    "q14_rates",
    EV + """, n AS (SELECT event, count(*) FILTER (plan = 'pro') AS part, count(plan) AS whole
                   FROM cur GROUP BY event)
    SELECT event, round(part::DOUBLE / whole, 4) AS share, 0.0::DOUBLE AS of_nothing FROM n""",
)
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.latest_rows(sample.events(spark, sf_dir))
    plan = Properties(["plan"]).display("plan")
    counted = rows.groupBy("event").agg(
        F.count_if(plan == "pro").alias("part"), F.count_if(plan != "").alias("whole")
    )
    return counted.select(
        "event", rate("part", "whole").alias("share"), rate(F.col("part"), F.lit(0)).alias("of_nothing")
    )


# --- Analytical queries -----------------------------------------------------------------------

RANGE = {"start": day(1), "end": day(29)}
IN_RANGE = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-29'"


@register(
    "a1_segmentation_total",
    EV + f""", spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-28',
                INTERVAL 1 DAY)) AS bucket),
    counted AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n FROM cur
                WHERE project_id = 'p0' AND event = 'purchase' AND {IN_RANGE} AND value > 20 GROUP BY 1)
    SELECT CAST(1 AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS segment, bucket,
           coalesce(n, 0) AS value, CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS total
    FROM spine LEFT JOIN counted USING (bucket)""",
)
def segmentation_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = SegmentationQuery(
        event="purchase", filters=[PropertyFilter("value", "gt", 20)], **RANGE
    )
    return segmentation.segmentation(sample.events(spark, sf_dir), P0, query)


@register(
    "a2_segmentation_persons",
    EV + f""" SELECT date_trunc('week', ts)::TIMESTAMP AS bucket, '' AS segment,
             count(DISTINCT person_id) AS value FROM people
    WHERE project_id = 'p0' AND event = 'view' AND {IN_RANGE} GROUP BY 1""",
)
def segmentation_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = SegmentationQuery(event="view", measure="unique_users", interval="week", **RANGE)
    return segmentation.segment_counts(sample.events(spark, sf_dir), P0, query)


@register(
    "a3_breakdown",
    EV + f""" SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, coalesce(plan, '$none') AS segment,
             count(*) AS value FROM cur
    WHERE project_id = 'p0' AND event = 'click' AND {IN_RANGE} GROUP BY ALL""",
)
def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = SegmentationQuery(event="click", breakdown="plan", **RANGE)
    return segmentation.segment_counts(sample.events(spark, sf_dir), P0, query)


def _top_sql(measure: str, source: str, segment: str, keep: int) -> str:
    return EV + f""", counted AS (
        SELECT date_trunc('week', ts)::TIMESTAMP AS bucket, {segment} AS segment, {measure} AS n
        FROM {source} WHERE project_id = 'p0' AND event = 'view' AND {IN_RANGE} GROUP BY ALL),
    ranked AS (SELECT segment, row_number() OVER (ORDER BY sum(n) DESC, segment) AS place
               FROM counted GROUP BY segment),
    folded AS (SELECT CAST(least(place, {keep + 1}) AS INTEGER) AS rank,
                      CASE WHEN place <= {keep} THEN segment ELSE '$other' END AS segment,
                      bucket, CAST(sum(n) AS BIGINT) AS value
               FROM counted JOIN ranked USING (segment) GROUP BY ALL)"""


_DENSE_SQL = """, spine AS (SELECT rank, segment, CAST(sum(value) AS BIGINT) AS total,
        unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-28', INTERVAL 7 DAY)) AS bucket
        FROM folded GROUP BY rank, segment)
    SELECT rank, segment, bucket, coalesce(value, 0) AS value, total
    FROM spine LEFT JOIN folded USING (rank, segment, bucket)"""


@register(
    "a4_top_segments",
    _top_sql("count(*)", "cur", "CAST(k AS VARCHAR)", 10)
    + " SELECT rank, segment, bucket, value FROM folded",
)
def top_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = SegmentationQuery(event="view", breakdown="k", interval="week", **RANGE)
    counts = segmentation.segment_counts(sample.events(spark, sf_dir), P0, query)
    return segmentation.fold_tail(counts, query.breakdown_limit)


@register(
    "a5_segmentation_series",
    _top_sql("count(DISTINCT person_id)", "people", "coalesce(plan, '$none')", 2) + _DENSE_SQL,
)
def segmentation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = SegmentationQuery(
        event="view",
        measure="unique_users",
        breakdown="plan",
        interval="week",
        breakdown_limit=2,
        **RANGE,
    )
    return segmentation.segmentation(sample.events(spark, sf_dir), P0, query)


FUNNEL = FunnelQuery(
    start=day(1),
    end=day(25),
    steps=[
        FunnelStep("view"),
        FunnelStep("click", [PropertyFilter("k", "gte", 30)]),
        FunnelStep("purchase", [PropertyFilter("value", "gt", 20)]),
        FunnelStep("purchase"),
    ],
    window_seconds=2 * 86_400,
)
# One row per (person, second, step); a chain of running maxima like the Spark side's, over
# exploded steps in (second, step) order.
LEVELS_SQL = EV + """,
hits AS (
    SELECT person_id, epoch_ms(ts) // 1000 AS s, step
    FROM people JOIN (VALUES (0), (1), (2), (3)) AS steps(step)
      ON CASE step WHEN 0 THEN event = 'view' AND ts < TIMESTAMP '2024-01-25'
                   WHEN 1 THEN event = 'click' AND k >= 30
                   WHEN 2 THEN event = 'purchase' AND value > 20
                   ELSE event = 'purchase' END
    WHERE project_id = 'p0' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-27'
),
m0 AS (SELECT *, max(CASE WHEN step = 0 THEN s END) OVER w AS c0 FROM hits
       WINDOW w AS (PARTITION BY person_id ORDER BY s, step ROWS UNBOUNDED PRECEDING)),
m1 AS (SELECT *, max(CASE WHEN step = 1 AND s - c0 <= 172800 THEN c0 END) OVER w AS c1 FROM m0
       WINDOW w AS (PARTITION BY person_id ORDER BY s, step ROWS UNBOUNDED PRECEDING)),
m2 AS (SELECT *, max(CASE WHEN step = 2 AND s - c1 <= 172800 THEN c1 END) OVER w AS c2 FROM m1
       WINDOW w AS (PARTITION BY person_id ORDER BY s, step ROWS UNBOUNDED PRECEDING)),
m3 AS (SELECT *, max(CASE WHEN step = 3 AND s - c2 <= 172800 THEN c2 END) OVER w AS c3 FROM m2
       WINDOW w AS (PARTITION BY person_id ORDER BY s, step ROWS UNBOUNDED PRECEDING)),
levels AS (
    SELECT person_id, CAST((max(c0) IS NOT NULL)::INT + (max(c1) IS NOT NULL)::INT
           + (max(c2) IS NOT NULL)::INT + (max(c3) IS NOT NULL)::INT AS INTEGER) AS level
    FROM m3 GROUP BY person_id HAVING max(c0) IS NOT NULL
)"""


@register("a6_funnel_levels", LEVELS_SQL + " SELECT person_id, level FROM levels")
def funnel_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel_levels(sample.events(spark, sf_dir), P0, FUNNEL)


@register("a6_funnel_levels_stretches", LEVELS_SQL + " SELECT person_id, level FROM levels")
def funnel_levels_by_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel_levels(sample.events(spark, sf_dir), P0, FUNNEL, stretch=funnel.DAY)


@register(
    "a7_funnel",
    LEVELS_SQL + """,
    reached AS (SELECT step, event, (SELECT count(*) FROM levels WHERE level >= step) AS users
                FROM (VALUES (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'purchase')) AS s(step, event))
    SELECT CAST(step AS INTEGER) AS step, event, users,
           round(users::DOUBLE / first_value(users) OVER o, 4) AS conversion_from_start,
           round(users::DOUBLE / coalesce(lag(users) OVER o, users), 4) AS conversion_from_previous
    FROM reached WINDOW o AS (ORDER BY step)""",
)
def funnel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel(sample.events(spark, sf_dir), P0, FUNNEL)


def _retention_sql(period: str, days: int, periods: int, start: str, end: str, returns: str) -> str:
    return EV + f""",
    cohorts AS (SELECT person_id, CAST(min(date_trunc('{period}', ts)) AS DATE) AS cohort FROM people
                WHERE project_id = 'p0' AND event = 'signup'
                  AND ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{end}' GROUP BY 1),
    activity AS (SELECT DISTINCT person_id, CAST(date_trunc('{period}', ts) AS DATE) AS period FROM people
                 WHERE project_id = 'p0' AND {returns} AND ts >= TIMESTAMP '{start}'
                   AND ts < TIMESTAMP '{end}' + INTERVAL {days * periods} DAY),
    matrix AS (SELECT cohort, CAST((period - cohort) // {days} AS INTEGER) AS "offset",
                      count(DISTINCT person_id) AS users
               FROM cohorts JOIN activity USING (person_id)
               WHERE (period - cohort) // {days} BETWEEN 0 AND {periods} GROUP BY ALL),
    sizes AS (SELECT cohort, count(*) AS size FROM cohorts GROUP BY cohort)"""


WEEKLY = RetentionQuery(
    start=day(3), end=day(20), start_event="signup", return_event="purchase", periods=2
)
WEEKLY_SQL = _retention_sql("week", 7, 2, "2024-01-03", "2024-01-20", "event = 'purchase'")
DAILY = RetentionQuery(start=day(2), end=day(9), start_event="signup", period="day", periods=14)
DAILY_SQL = _retention_sql("day", 1, 14, "2024-01-02", "2024-01-09", "true")


@register("a8_retention_matrix", DAILY_SQL + ' SELECT cohort, "offset", users FROM matrix')
def retention_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention_matrix(sample.events(spark, sf_dir), P0, DAILY)


@register("a9_cohort_sizes", WEEKLY_SQL + " SELECT cohort, size FROM sizes")
def cohort_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.cohort_sizes(sample.events(spark, sf_dir), P0, WEEKLY)


@register(
    "a10_retention",
    WEEKLY_SQL + """, dense AS (SELECT cohort, size, unnest(range(3))::INTEGER AS "offset" FROM sizes)
    SELECT cohort, size, "offset", coalesce(users, 0) AS users,
           round(coalesce(users, 0)::DOUBLE / size, 4) AS rate
    FROM dense LEFT JOIN matrix USING (cohort, "offset")""",
)
def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention(sample.events(spark, sf_dir), P0, WEEKLY)


SESSIONS = SessionsQuery(start=day(2, 7), end=day(27, 19), interval="day", inactivity_minutes=120)
SESSIONS_SQL = EV + """,
sorted AS (
    SELECT person_id, ts, CASE WHEN epoch_ms(ts) // 1000 - epoch_ms(lag(ts) OVER w) // 1000 <= 7200
                               THEN 0 ELSE 1 END AS opens
    FROM people WHERE project_id = 'p0' AND ts >= TIMESTAMP '2024-01-02 05:00:00'
      AND ts < TIMESTAMP '2024-01-28 19:00:00'
    WINDOW w AS (PARTITION BY person_id ORDER BY ts)
),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY person_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n
             FROM sorted),
found AS (
    SELECT person_id, min(ts) AS started, max(ts) AS ended, count(*) AS events
    FROM numbered GROUP BY person_id, n
    HAVING min(ts) >= TIMESTAMP '2024-01-02 07:00:00' AND min(ts) < TIMESTAMP '2024-01-27 19:00:00'
),
buckets AS (
    SELECT date_trunc('day', started)::TIMESTAMP AS bucket, count(*) AS sessions,
           count(DISTINCT person_id) AS users,
           CAST(sum(epoch_ms(ended) - epoch_ms(started)) AS BIGINT) AS total_duration_ms,
           count(*) FILTER (events = 1) AS bounces, CAST(sum(events) AS BIGINT) AS total_events
    FROM found GROUP BY 1
)"""


@register("a11_sessionize", SESSIONS_SQL + " SELECT person_id, started, ended, events FROM found")
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(sample.events(spark, sf_dir), P0, SESSIONS)


@register("a12_session_buckets", SESSIONS_SQL + " SELECT * FROM buckets")
def session_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessionize(sample.events(spark, sf_dir), P0, SESSIONS)
    return sessions.session_buckets(found, SESSIONS.interval)


_AVERAGES = """
    coalesce(round(total_duration_ms / 1000::DOUBLE / nullif(sessions, 0), 1), 0) AS avg_duration_seconds,
    coalesce(round(bounces::DOUBLE / nullif(sessions, 0), 4), 0) AS bounce_rate,
    coalesce(round(total_events::DOUBLE / nullif(sessions, 0), 2), 0) AS events_per_session"""


@register(
    "a13_session_report",
    SESSIONS_SQL + f""", dense AS (
        SELECT bucket, coalesce(sessions, 0) AS sessions, coalesce(users, 0) AS users,
               coalesce(total_duration_ms, 0) AS total_duration_ms, coalesce(bounces, 0) AS bounces,
               coalesce(total_events, 0) AS total_events
        FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-27',
                     INTERVAL 1 DAY)) AS bucket) LEFT JOIN buckets USING (bucket))
    SELECT bucket, sessions, users, {_AVERAGES} FROM dense""",
)
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_report(sample.events(spark, sf_dir), P0, SESSIONS)


@register(
    "a14_session_totals",
    SESSIONS_SQL + f""", totals AS (
        SELECT CAST(sum(sessions) AS BIGINT) AS sessions, sum(total_duration_ms) AS total_duration_ms,
               sum(bounces) AS bounces, sum(total_events) AS total_events FROM buckets)
    SELECT sessions, {_AVERAGES} FROM totals""",
)
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_totals(sample.events(spark, sf_dir), P0, SESSIONS)


LISTING = ListingQuery(as_of=day(25), days=20)
_LISTED = """ FROM ev WHERE project_id = 'p0' AND ts >= TIMESTAMP '2024-01-05'
    AND ts < TIMESTAMP '2024-01-25 00:05:00'"""


@register(
    "a15_event_names",
    EV + f" SELECT event, count(*) AS count {_LISTED} GROUP BY event",
)
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.event_names(sample.events(spark, sf_dir), P0, LISTING)


@register(
    "a16_violation_counts",
    EV + f""", found AS (SELECT event, unnest(string_split({VIOLATIONS}, '|')) AS violation {_LISTED})
    SELECT event, violation, count(*) AS count FROM found WHERE violation <> ''
    GROUP BY ALL""",
)
def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.violation_counts(sample.events(spark, sf_dir), P0, LISTING)


@register(
    "a17_event_summary",
    EV + """ SELECT event, count(*) AS rows, count(DISTINCT distinct_id) AS distinct_ids
            FROM cur GROUP BY event""",
)
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.event_summary(sample.events(spark, sf_dir))


@register(
    "a18_link_listing",
    EV + """ SELECT anonymous_id, user_id, min(ts) AS linked_at FROM ev
    WHERE project_id = 'p0' AND anonymous_id IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL""",
)
def link_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.list_links(identity.identity_links(sample.events(spark, sf_dir)), P0)


# --- The same queries over stored tables --------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Compacted events with their settled months, and links merged into buckets with one part since."""

    def write() -> str:
        path = _new_dir(spark, "stored")
        rows = sample.events(spark, sf_dir)
        event_table.write_events(rows, f"{path}/events", 0)
        found = identity.identity_links(rows)
        part = F.pmod(F.xxhash64("anonymous_id", "user_id"), F.lit(3))
        for batch in range(3):
            found.where(part == batch).write.parquet(f"{path}/links/batch_id={batch}")
        for month in event_table.months(spark, f"{path}/events"):
            event_table.compact_month(spark, f"{path}/events", month, file_bytes=1 << 20)
        link_table.compact_links(spark, f"{path}/links", committed=1)
        return path

    path = _once(spark, sf_dir, "stored", write)
    events, settled = event_table.open_events(spark, f"{path}/events")
    return events, link_table.read_links(spark, f"{path}/links"), settled


def _register_stored() -> None:
    """Each entry answers the query of the same name from the store: settled months skip the dedup, links are not derived."""
    persons = SegmentationQuery(event="view", measure="unique_users", interval="week", **RANGE)
    series = SegmentationQuery(
        event="view", measure="unique_users", breakdown="plan", interval="week", breakdown_limit=2, **RANGE
    )
    total = SegmentationQuery(event="purchase", filters=[PropertyFilter("value", "gt", 20)], **RANGE)
    plain = SegmentationQuery(event="click", breakdown="plan", **RANGE)
    top = SegmentationQuery(event="view", breakdown="k", interval="week", **RANGE)

    def found(events: DataFrame, *rest) -> DataFrame:
        return sessions.session_buckets(sessions.sessionize(events, *rest), SESSIONS.interval)

    def folded(events: DataFrame, *rest) -> DataFrame:
        return segmentation.fold_tail(segmentation.segment_counts(events, *rest), top.breakdown_limit)

    cases = {
        "a1_segmentation_total": (segmentation.segmentation, total),
        "a2_segmentation_persons": (segmentation.segment_counts, persons),
        "a3_breakdown": (segmentation.segment_counts, plain),
        "a4_top_segments": (folded, top),
        "a5_segmentation_series": (segmentation.segmentation, series),
        "a6_funnel_levels": (funnel.funnel_levels, FUNNEL),
        "a7_funnel": (funnel.funnel, FUNNEL),
        "a8_retention_matrix": (retention.retention_matrix, DAILY),
        "a9_cohort_sizes": (retention.cohort_sizes, WEEKLY),
        "a10_retention": (retention.retention, WEEKLY),
        "a11_sessionize": (sessions.sessionize, SESSIONS),
        "a12_session_buckets": (found, SESSIONS),
        "a13_session_report": (sessions.session_report, SESSIONS),
        "a14_session_totals": (sessions.session_totals, SESSIONS),
    }

    def query(operator, request) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            events, links, settled = _store(spark, sf_dir)
            return operator(events, P0, request, links, settled)

        return run

    for name, (operator, request) in cases.items():
        register(f"{name}_stored", ORACLES[name])(query(operator, request))
    # The two listings count every stored copy, so they read the table before compaction.
    for name, operator in (("a15_event_names", listings.event_names), ("a16_violation_counts", listings.violation_counts)):

        def listed(spark: SparkSession, sf_dir: str, operator=operator) -> DataFrame:
            return operator(event_table.scan_events(spark, _events_table(spark, sf_dir)), P0, LISTING)

        register(f"{name}_stored", ORACLES[name])(listed)


_register_stored()


@register("a17_event_summary_stored", ORACLES["a17_event_summary"])
def event_summary_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.event_summary(_store(spark, sf_dir)[0])


@register("a18_link_listing_stored", ORACLES["a18_link_listing"])
def link_listing_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.list_links(_store(spark, sf_dir)[1], P0)


@register(
    "s5_zone_scan",
    EV + """ SELECT event_id, event, ts AS timestamp FROM cur WHERE project_id = 'p0'
            AND event IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'""",
)
def zone_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compacted month with two micro-batches since, one of them with a zone map: only files that can match are read."""

    def write() -> str:
        path = _new_dir(spark, "zones")
        rows = sample.events(spark, sf_dir)
        event_table.write_events(rows, path, 0)
        for month in event_table.months(spark, path):
            event_table.compact_month(spark, path, month, file_bytes=1 << 20)
        for batch in (1, 2):  # copies, as a retry leaves them
            event_table.write_events(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch), path, batch)
        for month in event_table.months(spark, path):
            event_table.index_month(spark, path, month, committed=1)
        return path

    limits = (day(5), day(9), ["click", "purchase"])
    rows = event_table.scan_events(spark, _once(spark, sf_dir, "zones", write), P0, *limits)
    return scope.current_rows(rows, P0, *limits).select("event_id", "event", "timestamp")


# --- Tracking plans ---------------------------------------------------------------------------

PLANNERS = """
WITH planners AS (
    SELECT 's-' || CAST(s_suppkey AS VARCHAR) AS project_id, s_suppkey AS n FROM supplier
    UNION ALL SELECT '00000000-0000-4000-8000-00000000000' || CAST(i AS VARCHAR), i
    FROM range(2) AS r(i))"""


@register(
    "t1_latest_plans",
    PLANNERS + """ SELECT project_id, CAST(3 AS INTEGER) AS version,
        CASE WHEN n % 2 = 0 THEN 'block' ELSE 'warn' END AS enforcement,
        n % 4 <> 0 AS allow_unplanned_events, 'click,purchase' AS events FROM planners""",
)
def latest_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = tracking_plan.latest_plans(sample.tracking_plans(spark, sf_dir))
    return newest.select(
        "project_id",
        "version",
        "plan.enforcement",
        "plan.allow_unplanned_events",
        F.array_join(F.array_sort(F.map_keys("plan.events")), ",").alias("events"),
    )


@register(
    "t2_flat_plans",
    PLANNERS + """, specs(version, event, additional_properties, property, type, required, enum) AS (VALUES
        (1, 'purchase', true, 'plan', 'string', false, 'free,pro,team'),
        (1, 'purchase', true, 'value', 'number', false, NULL),
        (1, 'purchase', true, 'k', 'string', false, NULL),
        (1, 'legacy', true, NULL, NULL, NULL, NULL),
        (1, 'click', true, 'k', 'number', false, NULL),
        (2, 'purchase', false, 'plan', 'string', true, 'free,pro'),
        (2, 'purchase', false, 'value', 'number', false, NULL),
        (2, 'purchase', false, 'k', 'number', false, NULL),
        (2, 'click', false, 'k', 'number', false, NULL),
        (2, 'click', false, 'value', 'string', false, NULL)),
    versions AS (SELECT * FROM specs UNION ALL
                 SELECT 3, event, additional_properties, property, type, required, enum FROM specs
                 WHERE version = 2)
    SELECT project_id, CAST(version AS INTEGER) AS version,
           CASE WHEN version = 3 AND n % 2 = 0 THEN 'block' ELSE 'warn' END AS enforcement,
           NOT (version = 3 AND n % 4 = 0) AS allow_unplanned_events,
           event, additional_properties, property, type, required, enum
    FROM planners, versions""",
)
def flat_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tracking_plan.flatten_plans(sample.tracking_plans(spark, sf_dir))
    return flat.withColumn("enum", F.array_join("enum", ","))


CHANGES = PLANNERS + """, changes(from_version, position, change) AS (VALUES
        (1, 0, 'purchase:additional_properties_disallowed'),
        (1, 1, 'purchase.plan:now_required'),
        (1, 2, 'purchase.plan:enum_values_removed:[''team'']'),
        (1, 3, 'purchase.k:type_changed:string->number'),
        (1, 4, 'click:additional_properties_disallowed')),
    diffs AS (
        SELECT project_id, from_version, position, change FROM planners, changes
        UNION ALL SELECT project_id, 2, 0,
               'enforcement:warn->block (violating events will now be dropped)'
        FROM planners WHERE n % 2 = 0
        UNION ALL SELECT project_id, 2, 1, 'unplanned_events:now_disallowed'
        FROM planners WHERE n % 4 = 0)"""


@register(
    "t3_breaking_changes",
    CHANGES + """ SELECT project_id, CAST(from_version AS INTEGER) AS from_version,
        CAST(from_version + 1 AS INTEGER) AS to_version, CAST(position AS INTEGER) AS position, change
    FROM diffs""",
)
def breaking_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking_plan.breaking_changes(sample.tracking_plans(spark, sf_dir))


@register(
    "t4_next_versions",
    CHANGES + """, listed AS (SELECT project_id, string_agg(change, '|' ORDER BY position) AS changes
                 FROM diffs WHERE from_version = 2 GROUP BY project_id)
    SELECT project_id, CAST(3 AS INTEGER) AS version, coalesce(changes, '') AS changes,
           CASE WHEN changes IS NOT NULL AND n % 3 <> 0 THEN 'breaking_change' ELSE 'saved' END AS status
    FROM planners LEFT JOIN listed USING (project_id)""",
)
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = sample.tracking_plans(spark, sf_dir)
    number = F.regexp_extract("project_id", "([0-9]+)$", 1).cast("bigint")
    proposed = plans.filter("version = 3").select(
        "project_id", "plan", (number % 3 == 0).alias("allow_breaking")
    )
    decided = tracking_plan.next_versions(plans.filter("version < 3"), proposed)
    return decided.select(
        "project_id", "version", F.array_join("changes", "|").alias("changes"), "status"
    )


# --- The whole demo data set ------------------------------------------------------------------


@register(
    "demo_funnel",
    f"WITH {DEMO_USERS}, made AS ("
    + " UNION ALL ".join(DEMO_SQL.values())
    + """), t AS (SELECT distinct_id AS p,
        min(CASE WHEN event = 'signup' THEN timestamp END) AS s,
        min(CASE WHEN event = 'checkout_started' THEN timestamp END) AS c,
        min(CASE WHEN event = 'purchase' THEN timestamp END) AS b FROM made GROUP BY 1),
    n AS (SELECT count(s) AS s, count(CASE WHEN c >= s THEN 1 END) AS c,
                 count(CASE WHEN c >= s AND b >= c THEN 1 END) AS b FROM t)
    SELECT CAST(1 AS INTEGER) AS step, 'signup' AS event, s AS users, 1.0::DOUBLE AS conversion_from_start,
           1.0::DOUBLE AS conversion_from_previous FROM n
    UNION ALL SELECT 2, 'checkout_started', c, round(c::DOUBLE / s, 4), round(c::DOUBLE / s, 4) FROM n
    UNION ALL SELECT 3, 'purchase', b, round(b::DOUBLE / s, 4), round(b::DOUBLE / c, 4) FROM n""",
)
def demo_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generate.demo_events(_users(spark, sf_dir), DEMO_PROJECT, DEMO_START)
    steps = [FunnelStep(name) for name in ("signup", "checkout_started", "purchase")]
    query = FunnelQuery(start=DEMO_START, end=DEMO_START + timedelta(weeks=8), steps=steps)
    return funnel.funnel(made, DEMO_PROJECT, query)
