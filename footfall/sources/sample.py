"""The driver's tables seen as event tables, client batches, log messages and tracking plans.

``events`` has no tenant, one identity per row and no copies; all three are derived from the
ids, and the faults of client batches and log messages are too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.scalars import iso
from footfall.operators.tracking_plan import parse_plans
from footfall.schemas import EVENTS

PROJECT = "p0"
COPY_OFFSET = 1_000_000_000
#: Rows of a table a task makes texts from. A row has 10 to 20 bytes in Parquet and up to a thousand as a text, so
#: a split of Parquet that is small to read is far too much for one task.
TASK_ROWS = 50_000


def tasks_for(rows: DataFrame) -> int:
    """One task for each ``TASK_ROWS`` rows of a table; their number is read from Parquet footers."""
    return max(1, math.ceil(rows.count() / TASK_ROWS))


def _raw(spark: SparkSession, sf_dir: str, spread_by: dict[str, Column] | None = None) -> DataFrame:
    """The events with one column for each thing that follows from the ids.

    With ``spread_by`` the rows are dealt by these columns, which are kept, over one task for each ``TASK_ROWS`` rows, while they
    are still as narrow as they are stored.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = spread_by or {}
    if keys:
        rows = rows.withColumns(keys).repartition(tasks_for(rows), *keys)
    anonymous = F.when(
        F.expr("user_id % 3 <> 2"), F.concat(F.lit("anon-"), F.expr("cast(user_id div 2 as string)"))
    )
    hidden = (
        F.col("event_type").isin("view", "click")
        & F.expr("event_id % 2 = 0")
        & F.expr("user_id % 3 <> 2")
    )
    known = F.concat(F.lit("u-"), F.col("user_id").cast("string"))
    plan = F.expr("case event_id % 4 when 0 then 'free' when 1 then 'pro' when 2 then 'team' end")
    return rows.select(
        F.col("event_id").alias("id"),
        _project().alias("project_id"),
        event_uuid(F.col("event_id")).alias("event_id"),
        F.col("event_type").alias("event"),
        F.when(~hidden, known).alias("user_id"),
        anonymous.alias("anonymous_id"),
        F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat(
            F.expr("substring(props, 1, length(props) - 1)"),
            F.lit(', "value": '),
            F.col("value").cast("string"),
            F.coalesce(F.concat(F.lit(', "plan": "'), plan, F.lit('"')), F.lit("")),
            F.lit("}"),
        ).alias("properties"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        *keys,
    )


def _project() -> Column:
    return F.when(F.expr("user_id % 10 = 9"), "p1").otherwise("p0")


def event_uuid(number: Column) -> Column:
    """A UUID-shaped text holding the number."""
    low = F.lpad((number % 100_000_000).cast("string"), 8, "0")
    high = F.lpad(F.floor(number / 100_000_000).cast("string"), 12, "0")
    return F.concat(low, F.lit("-0000-4000-8000-"), high)


def project_uuid(project_id: Column | str) -> Column:
    """Project id as the log has it."""
    digit = F.substring(project_id, 2, 1)
    return F.concat(F.lit("00000000-0000-4000-8000-00000000000"), digit)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events table. Every 50th event has a second copy, stored a second later, whose
    corrected time is half a second later: a client retry."""
    copies = F.expr("case when id % 50 = 0 then array(0, 1) else array(0) end")
    rows = _raw(spark, sf_dir).withColumn("copy", F.explode(copies))
    shifted = F.col("timestamp") + F.col("copy") * F.expr("interval 500 milliseconds")
    missing = F.when(F.expr("id % 4 = 3"), "missing_required:plan")
    refused = F.when(F.col("k") >= 90, "value_not_allowed:k")
    given = {
        "distinct_id": F.coalesce("user_id", "anonymous_id"),
        "timestamp": shifted,
        "received_at": F.col("timestamp"),
        "context": F.lit("{}"),
        "kafka_partition": F.expr("id % 6"),
        "kafka_offset": F.expr(f"id div 6 + copy * {COPY_OFFSET}"),
        "ingested_at": F.timestamp_micros(
            F.unix_micros("timestamp") + (F.expr("id % 400") + F.col("copy")) * 1_000_000
        ),
        "violations": F.filter(F.array(missing, refused), lambda v: v.isNotNull()),
    }
    kept = {"project_id", "event_id", "event", "user_id", "anonymous_id", "properties"}
    return rows.select(
        *(
            (F.col(f.name) if f.name in kept else given.get(f.name, F.lit(None)))
            .cast(f.dataType)
            .alias(f.name)
            for f in EVENTS.fields
        )
    )


def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client batches of at most 25 neighbouring events of one project, with faults by id.

    Two of three batches come from a clock two hours ahead; the others do not say when they
    were sent, and some of their events claim the next day.
    """
    batch = {
        "project": project_uuid(_project()),
        "number": F.concat(F.lit("b-"), F.expr("cast(event_id div 25 as string)")),
        "measured": F.expr("event_id div 25 % 3 <> 0"),
    }
    # By batch, so that the rows need not be shuffled again as texts.
    rows = _raw(spark, sf_dir, batch)
    measured = F.col("measured")
    client = (
        F.when(F.expr("id % 7 = 0"), F.lit(None).cast("timestamp"))
        .when(measured, F.col("timestamp") + F.expr("interval 2 hours"))
        .when(F.expr("id % 11 = 0"), F.col("timestamp") + F.expr("interval 1 day"))
        .otherwise(F.col("timestamp"))
    )
    client_text = F.when(
        F.expr("id % 53 = 3"), F.date_format(client, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ).otherwise(F.date_format(client, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))

    def member(name: str, text: Column, quote: bool = True) -> Column:
        """``"name":value`` of the item, NULL when there is no value."""
        mark = '"' if quote else ""
        return F.concat(F.lit(f'"{name}":{mark}'), text, F.lit(mark))

    event_id = F.when(F.expr("id % 43 = 1"), "not-a-uuid").otherwise(F.col("event_id"))
    nobody = F.expr("id % 47 = 2")
    properties = (
        F.when(F.expr("id % 61 = 5"), "[1, 2]")
        .when(
            F.expr("id % 67 = 6"),
            F.concat(F.lit('{"blob": "'), F.repeat(F.lit("x"), 32_001), F.lit('"}')),
        )
        .otherwise(F.col("properties"))
    )
    typo = F.expr("id % 41 = 0")
    members = F.array(
        member("event_id", event_id),
        member("event", F.when(F.expr("id % 59 = 4"), "").otherwise(F.col("event"))),
        member("user_id", F.when(~nobody, F.col("user_id"))),
        member("anonymous_id", F.when(~nobody, F.col("anonymous_id"))),
        member("timestamp", client_text),
        member("properties", F.when(~typo, properties), quote=False),
        member("propertes", F.when(typo, properties), quote=False),
    )
    item = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    items = rows.select(*batch, "timestamp", F.struct("id", item.alias("item")).alias("item"))
    gathered = items.groupBy(*batch).agg(
        F.max("timestamp").alias("last"), F.sort_array(F.collect_list("item")).alias("items")
    )
    received = F.col("last") + F.expr("interval 5 seconds")
    return gathered.select(
        F.concat_ws("/", F.substring("project", 36, 1), "number").alias("batch_id"),
        F.col("project").alias("project_id"),
        received.alias("received_at"),
        F.lit("10.0.0.1").alias("ip"),
        F.when(F.col("measured"), received + F.expr("interval 2 hours")).alias("sent_at"),
        F.col("items.item").alias("batch"),
    )


def tracking_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three plan versions for every supplier, and for the two projects of the events.

    Version 2 requires ``plan``, changes the type of ``k`` and narrows the enum; version 3 blocks
    and, for even suppliers, no longer allows unplanned events.
    """
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("project_id"),
        F.col("s_suppkey").alias("n"),
    )
    own = (
        spark.range(2)
        .select(project_uuid(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("project_id"), F.col("id").alias("n"))
    )
    numbered = suppliers.unionByName(own).withColumn(
        "version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    )
    first = (
        '{"events": {"purchase": {"properties": {"plan": {"type": "string",'
        ' "enum": ["free", "pro", "team"]}, "value": {"type": "number"}, "k": {"type": "string"}}},'
        ' "legacy": {}, "click": {"additional_properties": true, "properties": {"k": {"type": "number"}}}}}'
    )
    second = (
        '{"events": {"purchase": {"additional_properties": false, "properties": {"plan": {"type":'
        ' "string", "required": true, "enum": ["free", "pro"]}, "value": {"type": "number"}, "k":'
        ' {"type": "number"}}}, "click": {"additional_properties": false, "properties":'
        ' {"k": {"type": "number"}, "value": {"type": "string"}}}}}'
    )
    third = F.concat(
        F.lit('{"enforcement": "'),
        F.expr("case when n % 2 = 0 then 'block' else 'warn' end"),
        F.lit('", "allow_unplanned_events": '),
        F.expr("case when n % 4 = 0 then 'false' else 'true' end"),
        F.lit(f', {second[1:]}'),
    )
    text = F.when(F.col("version") == 1, first).when(F.col("version") == 2, second).otherwise(third)
    return parse_plans(numbered.select("project_id", "version", text.alias("plan")))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: a version 1 message per event, with poison by id, and every 50th message
    sent again (a client retry with a later time of receipt)."""
    copies = F.expr("case when id % 50 = 0 then array(0, 1) else array(0) end")
    rows = _raw(spark, sf_dir, {"number": F.col("event_id")}).withColumn("copy", F.explode(copies))
    moment = F.col("timestamp") + F.col("copy") * F.expr("interval 500 milliseconds")
    body = F.to_json(
        F.struct(
            F.when(F.expr("id % 31 = 2"), F.lit(7)).otherwise(F.lit(1)).alias("schema_version"),
            project_uuid("project_id").alias("project_id"),
            F.when(F.expr("id % 37 = 3"), "broken").otherwise(F.col("event_id")).alias("event_id"),
            "event",
            F.coalesce("user_id", "anonymous_id").alias("distinct_id"),
            "user_id",
            "anonymous_id",
            iso(moment).alias("timestamp"),
            F.lit(None).cast("string").alias("client_timestamp"),
            F.lit(None).cast("string").alias("sent_at"),
            iso(moment).alias("received_at"),
            F.lit(None).cast("string").alias("ip"),
            F.parse_json("properties").alias("properties"),
            F.parse_json(F.lit("{}")).alias("context"),
        ),
        {"ignoreNullFields": "false"},
    )
    value = (
        F.when(F.expr("id % 23 = 1"), F.concat(F.lit("{broken "), F.col("event_id")))
        .when(F.expr("id % 29 = 4"), F.lit("[1, 2, 3]"))
        .otherwise(body)
    )
    return rows.select(
        F.concat_ws(
            ":", project_uuid("project_id"), F.coalesce("user_id", "anonymous_id")
        ).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit("events.raw").alias("topic"),
        F.expr("cast(id % 6 as int)").alias("partition"),
        F.expr(f"id div 6 + copy * {COPY_OFFSET}").alias("offset"),
    )
