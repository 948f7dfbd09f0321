"""Batch ingestion: client batches in, accepted messages and rejected events out.

Items carry their position in the batch to the end, so a rejection names it. The stages are
plain column expressions on one row per item; only the plan lookup is a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.props import Properties, json_type, whole_rows
from footfall.functions.scalars import (
    ANY_TIMESTAMP,
    canonical_uuid,
    histogram_edge,
    iso,
    zoned_timestamp,
)
from footfall.operators.tracking_plan import latest_plans, planned_events, spec_violations
from footfall.plans import limits

FIELDS = ("event_id", "event", "user_id", "anonymous_id", "timestamp", "properties", "context")
MESSAGE_VERSION = 1

# Fixed texts of validation errors.
REQUIRED = "Field required"
NOT_STRING = "Input should be a valid string"
NOT_UUID_TEXT = "UUID input should be a string, bytes or UUID object"
NOT_UUID = "Input should be a valid UUID"
NOT_OBJECT = "Input should be a valid dictionary"
NOT_TIME = "Input should be a valid datetime"
NO_ZONE = "Input should have timezone info"
UNKNOWN_FIELD = "Extra inputs are not permitted"
NO_IDENTITY = "Value error, one of user_id or anonymous_id is required"


def explode_batches(
    batches: DataFrame,
    max_events: int = limits.MAX_BATCH_EVENTS,
    over_quota: DataFrame | None = None,
) -> DataFrame:
    """One row per item with its 0-based ``index``, and why its batch is refused whole.

    ``refusal`` is ``invalid_batch`` (empty, or an item that is no JSON object),
    ``batch_too_large``, ``quota_exceeded`` (batches of ``over_quota``, by project and id) or NULL. An empty
    batch keeps one row without an item.
    """
    not_object = F.exists("batch", lambda item: F.json_object_keys(item).isNull())
    empty = F.coalesce(F.size("batch"), F.lit(0)) <= 0
    refusal = F.when(empty | F.coalesce(not_object, F.lit(False)), "invalid_batch").when(
        F.size("batch") > max_events, "batch_too_large"
    )
    marked = batches.withColumn("refusal", refusal)
    if over_quota is not None:
        flagged = over_quota.select("project_id", "batch_id", F.lit("quota_exceeded").alias("_quota"))
        marked = marked.join(flagged.distinct(), ["project_id", "batch_id"], "left").withColumn(
            "refusal", F.coalesce("refusal", "_quota")
        )
    return marked.select(
        "batch_id",
        "project_id",
        "received_at",
        "ip",
        "sent_at",
        F.greatest(F.coalesce(F.size("batch"), F.lit(0)), F.lit(0)).alias("batch_size"),
        "refusal",
        F.posexplode_outer("batch").alias("index", "item"),
    )


def text_error(name: str, kind: Column, text: Column, longest: int | None, required: bool) -> Column:
    """What is wrong with a text field, given its JSON type and its text; NULL when fine."""
    if required:
        error = F.when(kind.isNull(), f"{name}: {REQUIRED}")
    else:
        error = F.when(kind.isNull() | (kind == "null"), F.lit(None).cast("string"))
    error = error.when(kind != "string", f"{name}: {NOT_STRING}")
    if longest is None:
        return error
    return error.when(
        F.length(text) < 1, f"{name}: String should have at least 1 character"
    ).when(F.length(text) > longest, f"{name}: String should have at most {longest} characters")


def client_time(kind: Column, text: Column, value: Column) -> Column:
    """Instant of a client timestamp: ISO text with a zone, or a Unix time in seconds
    (milliseconds from 2e10 on)."""
    number = F.try_variant_get(value, "$", "double")
    scale = F.when(F.abs(number) <= 2e10, F.lit(1e6)).otherwise(F.lit(1e3))
    return F.when(kind == "string", zoned_timestamp(text)).when(
        kind == "number", F.timestamp_micros(F.round(number * scale).cast("bigint"))
    )


def time_error(name: str, kind: Column, text: Column, instant: Column) -> Column:
    without_zone = F.coalesce(
        text.rlike(ANY_TIMESTAMP) & F.try_to_timestamp(text).isNotNull(), F.lit(False)
    )
    return F.when(
        kind.isNotNull() & (kind != "null") & instant.isNull(),
        F.when(without_zone, f"{name}: {NO_ZONE}").otherwise(f"{name}: {NOT_TIME}"),
    )


def _present(*texts: Column) -> Column:
    """The non-NULL ones of distinct texts, in order. A set difference, since a lambda would
    take the expressions of the texts out of generated code."""
    return F.array_except(F.array(*texts), F.array(F.lit(None).cast("string")))


def object_error(name: str, kind: Column) -> Column:
    return F.when(kind.isNotNull() & (kind != "object"), f"{name}: {NOT_OBJECT}")


def open_fields(rows: DataFrame, source: str, names: tuple[str, ...]) -> DataFrame:
    """For each named field of a JSON object column: ``_v_<name>`` (VARIANT), ``_k_<name>`` (JSON
    type) and ``_s_<name>`` (its text when a string). Computed once, however often used."""
    raw = Properties(names, source=source)
    return typed_fields(rows.withColumn("_raw", raw.parsed()), names)


def typed_fields(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The columns of ``open_fields`` from ``_raw``, a struct with a VARIANT for each name."""
    fields = rows.schema["_raw"].dataType.fieldNames()
    opened = rows.withColumns({f"_v_{n}": F.col(f"_raw.{f}") for n, f in zip(names, fields, strict=True)})
    return opened.withColumns({f"_k_{n}": json_type(F.col(f"_v_{n}")) for n in names}).withColumns({
        f"_s_{n}": F.when(
            F.col(f"_k_{n}") == "string", F.try_variant_get(f"_v_{n}", "$", "string")
        )
        for n in names
    })


def validate(items: DataFrame, max_properties_bytes: int = limits.MAX_PROPERTIES_BYTES) -> DataFrame:
    """Typed event columns and ``errors`` (every field error, empty when the event is valid).

    The identity and size rules are looked at only when all fields are valid.
    """
    opened = open_fields(items, "item", FIELDS)
    kind = {name: F.col(f"_k_{name}") for name in FIELDS}
    text = {name: F.col(f"_s_{name}") for name in FIELDS}
    value = {name: F.col(f"_v_{name}") for name in FIELDS}
    typed_rows = opened.withColumns({
        "event_id": canonical_uuid(text["event_id"]),
        "given_event_id": F.when(
            kind["event_id"] != "null", F.coalesce(text["event_id"], F.to_json(value["event_id"]))
        ),
        "event": text["event"],
        "user_id": text["user_id"],
        "anonymous_id": text["anonymous_id"],
        "client_timestamp": client_time(kind["timestamp"], text["timestamp"], value["timestamp"]),
        "properties": F.coalesce(F.to_json(value["properties"]), F.lit("{}")),
        "context": F.coalesce(F.to_json(value["context"]), F.lit("{}")),
        "_unknown": F.array_except(
            F.json_object_keys("item"), F.array(*(F.lit(name) for name in FIELDS))
        ),
    })
    event_id_error = (
        F.when(kind["event_id"].isNull(), f"event_id: {REQUIRED}")
        .when(kind["event_id"] != "string", f"event_id: {NOT_UUID_TEXT}")
        .when(F.col("event_id").isNull(), f"event_id: {NOT_UUID}")
    )
    longest = limits.MAX_DISTINCT_ID
    listed = _present(
        event_id_error,
        text_error("event", kind["event"], text["event"], limits.MAX_EVENT_NAME, True),
        text_error("user_id", kind["user_id"], text["user_id"], longest, False),
        text_error("anonymous_id", kind["anonymous_id"], text["anonymous_id"], longest, False),
        time_error("timestamp", kind["timestamp"], text["timestamp"], F.col("client_timestamp")),
        object_error("properties", kind["properties"]),
        object_error("context", kind["context"]),
    )
    surplus = F.transform("_unknown", lambda key: F.concat(key, F.lit(f": {UNKNOWN_FIELD}")))
    none = F.array().cast("array<string>")
    whole_event = F.when(
        F.col("user_id").isNull() & F.col("anonymous_id").isNull(), f"event: {NO_IDENTITY}"
    ).when(
        F.octet_length("properties") > max_properties_bytes,
        f"event: Value error, properties exceed {max_properties_bytes} bytes",
    )
    judged = typed_rows.withColumn("_errors", F.concat(listed, F.coalesce(surplus, none)))
    errors = F.when(F.size("_errors") > 0, F.col("_errors")).otherwise(
        _present(whole_event)
    )
    finished = (
        "event_id",
        "given_event_id",
        "event",
        "user_id",
        "anonymous_id",
        "client_timestamp",
        "properties",
        "context",
        "errors",
    )
    return judged.withColumn("errors", errors).select(whole_rows(*items.columns, *finished))


def distinct_id(user_id: Column | str = "user_id", anonymous_id: Column | str = "anonymous_id"):
    """The identity an event is filed under: the user if known."""
    return F.coalesce(user_id, anonymous_id, F.lit(""))


def corrected_timestamp(
    client_timestamp: Column | str,
    sent_at: Column | str,
    received_at: Column | str,
    max_skew_seconds: int = limits.MAX_FUTURE_SKEW_SECONDS,
) -> Column:
    """When the event happened. The client's clock may be wrong, but the time between two of
    its readings is right, so the age at sending is taken off the time of receipt. Without
    ``sent_at`` the client is trusted; a result too far ahead becomes the time of receipt."""
    client, sent, received = (F.unix_micros(c) for c in (client_timestamp, sent_at, received_at))
    happened = F.when(sent.isNotNull(), received - (sent - client)).otherwise(client)
    too_late = happened > received + max_skew_seconds * 1_000_000
    micros = F.when(happened.isNull() | too_late, received).otherwise(happened)
    return F.timestamp_micros(micros)


#: A busy project's items meet its rules in a part for each so many of its batches.
PART_BATCHES = 4_000
#: Projects looked at for that; each other one has less than this share of all batches.
BUSY_PROJECTS = 500


def busy_projects(batches: DataFrame) -> DataFrame:
    """``project_id, _parts`` of the projects with most batches, those that need more than one part.

    Counts rows only, so the items are not made for it; ``BUSY_PROJECTS`` rows at most.
    """
    counted = batches.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / PART_BATCHES).cast("int").alias("_parts")
    most = counted.orderBy(F.desc("n")).limit(BUSY_PROJECTS)
    return most.select("project_id", parts).filter("_parts > 1")


def plans_in_use(plans: DataFrame, batches: DataFrame) -> DataFrame:
    """The plans of projects that sent a batch; no item can meet the others.

    Items then wait for no sort against rules nobody needs: where few projects send, adaptive execution
    broadcasts their rules, however many plans there are. A task holds the ids of a partition's projects alone.
    """
    used = batches.select("project_id").distinct()
    return plans.join(used.hint("shuffle_hash"), "project_id", "left_semi")


def _with_parts(rows: DataFrame, busy: DataFrame | None) -> DataFrame:
    """Adds ``_parts``: how many parts the items of the row's project are spread over."""
    if busy is None:
        return rows.withColumn("_parts", F.lit(1))
    return rows.join(F.broadcast(busy), "project_id", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))


def rules_by_part(plans: DataFrame, busy: DataFrame | None) -> DataFrame:
    """``project_id, _salt, plan``: the active plans, a copy for each part of a project."""
    active = _with_parts(latest_plans(plans).select("project_id", "plan"), busy)
    return active.select(
        "project_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"), "plan"
    )


def check_plans(items: DataFrame, plans: DataFrame, busy: DataFrame | None = None) -> DataFrame:
    """Add ``violations`` and ``enforcement`` from the active plan of each project.

    An item meets the rules of its own event, by (project, event), never a whole plan. What
    holds for all events of a project comes by a second join. Both are by part of a project too, so that the
    items of a huge one (``busy_projects``), and of an event it sends most, are spread; the rules of
    all others stay single, however many plans there are.
    """
    active = rules_by_part(plans, busy)
    defaults = active.select(
        "project_id",
        F.col("plan.enforcement").alias("enforcement"),
        F.col("plan.allow_unplanned_events").alias("_open"),
        "_salt",
    )
    salt = F.pmod(F.xxhash64("batch_id", "index"), "_parts").cast("int")
    joined = (
        _with_parts(items, busy)
        .withColumn("_salt", salt)
        .drop("_parts")
        .join(planned_events(active, "_salt"), ["project_id", "event", "_salt"], "left")
        .join(defaults, ["project_id", "_salt"], "left")
    )
    properties = F.coalesce(
        F.from_json("properties", T.MapType(T.StringType(), T.VariantType())),
        F.create_map().cast("map<string,variant>"),
    )
    return (
        joined.withColumn("_properties", properties)
        .withColumn(
            "violations", spec_violations(F.col("_properties"), F.col("spec"), F.col("_open"))
        )
        .drop("spec", "_open", "_properties", "_salt")
    )


def route(checked: DataFrame) -> DataFrame:
    """Add ``outcome`` (accepted, rejected_validation, rejected_plan, rejected_quota, refused)
    and the final ``errors``."""
    invalid = F.size("errors") > 0
    blocked = (F.col("enforcement") == "block") & (F.size("violations") > 0)
    outcome = (
        F.when(F.col("refusal") == "quota_exceeded", "rejected_quota")
        .when(F.col("refusal").isNotNull(), "refused")
        .when(invalid, "rejected_validation")
        .when(blocked, "rejected_plan")
        .otherwise("accepted")
    )
    plan_errors = F.transform("violations", lambda v: F.concat(F.lit("tracking_plan: "), v))
    routed = checked.withColumn("outcome", outcome).withColumn(
        "errors", F.when(F.col("outcome") == "rejected_plan", plan_errors).otherwise(F.col("errors"))
    )
    return routed.select(whole_rows(*routed.columns))


def messages(accepted: DataFrame) -> DataFrame:
    """Version 1 log messages: ``key, value`` plus the ids they carry."""

    def nested(column: str) -> Column:
        return F.parse_json(column).alias(column)

    body = F.struct(
        F.lit(MESSAGE_VERSION).alias("schema_version"),
        "project_id",
        "event_id",
        "event",
        "distinct_id",
        "user_id",
        "anonymous_id",
        iso("timestamp").alias("timestamp"),
        iso("client_timestamp").alias("client_timestamp"),
        iso("sent_at").alias("sent_at"),
        iso("received_at").alias("received_at"),
        "ip",
        nested("properties"),
        nested("context"),
        "violations",
    )
    return accepted.select(
        "project_id",
        "event_id",
        "distinct_id",
        user_key().cast("binary").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).cast("binary").alias("value"),
    )


def user_key() -> Column:
    """Log key: all events of one user of one project share it, and so a partition."""
    return F.concat_ws(":", "project_id", "distinct_id")


def assign_partition(rows: DataFrame, partitions: int) -> DataFrame:
    """``partition`` of each row by its user key, for logs kept as files."""
    return rows.withColumn(
        "partition", F.pmod(F.xxhash64(user_key()), F.lit(partitions)).cast("int")
    )


@dataclass(frozen=True)
class Ingested:
    """All items with their outcome; the views below are filters on it."""

    items: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.items.filter("outcome = 'accepted'")

    @property
    def rejected(self) -> DataFrame:
        """Rejected events of admitted batches; sort by ``batch_id, index`` to present them."""
        rows = self.items.filter(F.col("outcome").isin("rejected_validation", "rejected_plan"))
        return rows.select(
            "batch_id", "project_id", "index", F.col("given_event_id").alias("event_id"), "errors"
        )

    def messages(self) -> DataFrame:
        return messages(self.accepted)

    def outcome_counts(self) -> DataFrame:
        """``outcome, events`` over all items; refused batches count as ``refused``."""
        real = self.items.filter(F.col("item").isNotNull())
        return real.groupBy("outcome").agg(F.count(F.lit(1)).alias("events"))

    def batch_results(self) -> DataFrame:
        """``batch_id, project_id, status, accepted, rejected``: what each client is told."""
        counted = self.items.groupBy("batch_id", "project_id").agg(
            F.max("refusal").alias("refusal"),
            F.count_if(F.col("outcome") == "accepted").alias("accepted"),
            F.count_if(F.col("outcome").startswith("rejected_") & F.col("refusal").isNull()).alias(
                "rejected"
            ),
        )
        status = F.coalesce(
            "refusal", F.when(F.col("accepted") == 0, "no_valid_events").otherwise("accepted")
        )
        return counted.select("batch_id", "project_id", status.alias("status"), "accepted", "rejected")


def ingest(
    batches: DataFrame,
    plans: DataFrame | None = None,
    over_quota: DataFrame | None = None,
    max_events: int = limits.MAX_BATCH_EVENTS,
    max_properties_bytes: int = limits.MAX_PROPERTIES_BYTES,
) -> Ingested:
    """Validate, correct clocks, check plans and route every item of the batches."""
    checked = validate(explode_batches(batches, max_events, over_quota), max_properties_bytes)
    checked = checked.withColumns({
        "distinct_id": distinct_id(),
        "timestamp": corrected_timestamp("client_timestamp", "sent_at", "received_at"),
    })
    if plans is None:
        checked = checked.withColumns({
            "violations": F.array().cast("array<string>"),
            "enforcement": F.lit(None).cast("string"),
        })
    else:
        checked = check_plans(checked, plans_in_use(plans, batches), busy_projects(batches))
    return Ingested(route(checked))


def batch_sizes(batches: DataFrame) -> DataFrame:
    """``edge, batches, events``: histogram of batch sizes by the fixed edges."""
    size = F.greatest(F.coalesce(F.size("batch"), F.lit(0)), F.lit(0))
    sized = batches.select(
        histogram_edge(size, limits.BATCH_SIZE_EDGES).alias("edge"), size.alias("size")
    )
    return sized.groupBy("edge").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("size").alias("events")
    )
