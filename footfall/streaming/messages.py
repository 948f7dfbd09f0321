"""Log messages to event rows, or to dead letters that say why not. Never fails on a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.props import display, json_type, typed, whole_rows
from footfall.functions.scalars import canonical_uuid
from footfall.functions.timebuckets import millis
from footfall.operators.ingest import (
    MESSAGE_VERSION,
    NOT_OBJECT,
    NOT_STRING,
    NOT_UUID,
    NOT_TIME,
    REQUIRED,
    client_time,
    time_error,
    typed_fields,
)

FIELDS = (
    "schema_version",
    "project_id",
    "event_id",
    "event",
    "distinct_id",
    "user_id",
    "anonymous_id",
    "timestamp",
    "client_timestamp",
    "received_at",
    "ip",
    "properties",
    "context",
    "violations",
)
_UUIDS = ("project_id", "event_id")
_TIMES = ("timestamp", "client_timestamp", "received_at")


def _field_error(name: str) -> Column:
    """First thing wrong with one field, as ``path:message``; NULL when it is fine."""
    kind, text = F.col(f"_k_{name}"), F.col(f"_s_{name}")
    if name == "violations":  # added later, so it may be absent
        at = F.array_position(F.transform("_list", lambda v: json_type(v) != "string"), True) - 1
        return F.when(
            kind.isNotNull() & (kind != "array"), f"{name}:Input should be a valid list"
        ).when(at >= 0, F.concat(F.lit(f"{name}."), at.cast("string"), F.lit(f":{NOT_STRING}")))
    missing = F.when(kind.isNull(), f"{name}:{REQUIRED}")
    if name in _UUIDS:
        return missing.when(F.col(name).isNull(), f"{name}:{NOT_UUID}")
    if name in ("event", "distinct_id"):
        return missing.when(kind != "string", f"{name}:{NOT_STRING}")
    if name in ("user_id", "anonymous_id", "ip"):
        return missing.when(~kind.isin("string", "null"), f"{name}:{NOT_STRING}")
    if name in ("properties", "context"):
        return missing.when(kind != "object", f"{name}:{NOT_OBJECT}")
    wrong = F.regexp_replace(time_error(name, kind, text, F.col(name)), ": ", ":")
    if name != "client_timestamp":  # the only time that may be null
        missing = missing.when(kind == "null", f"{name}:{NOT_TIME}")
    return missing.otherwise(wrong)


def open_messages(messages: DataFrame) -> DataFrame:
    """Adds ``_is_json``, ``_is_object`` and ``_raw`` (a VARIANT per field, in the order of FIELDS), from one parse.

    Spark's parsers stop after the first value. The text is therefore parsed as the first element of a list whose second
    is the hash of the text: a rest of any kind, even one that closes the list, keeps the hash from standing there, and
    no text can hold its own hash.
    """
    body, seal = F.col("_body"), F.md5(F.col("value"))
    rows = messages.withColumn("_body", F.col("value").cast("string")).withColumn(
        "_sealed",
        F.when(F.is_valid_utf8(body), F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), seal, F.lit('"]')))),
    )
    fields = ", ".join(f"{name}: variant" for name in FIELDS)
    return rows.withColumns({
        "_is_json": F.coalesce(F.try_variant_get("_sealed", "$[1]", "string") == seal, F.lit(False)),
        "_raw": F.try_variant_get("_sealed", "$[0]", f"struct<{fields}>"),
    }).withColumn("_is_object", F.col("_raw").isNotNull())


def parse_messages(messages: DataFrame) -> DataFrame:
    """Typed event columns, lineage, the original record, and ``reason``: NULL for a row, else
    the first that applies of invalid_json, not_an_object, unsupported_schema_version:<v> and
    invalid_message:<path>:<message>.
    """
    rows = open_messages(messages)
    opened = typed_fields(rows, FIELDS)
    opened = opened.withColumns(
        {name: canonical_uuid(F.col(f"_s_{name}")) for name in _UUIDS}
        | {
            name: client_time(F.col(f"_k_{name}"), F.col(f"_s_{name}"), F.col(f"_v_{name}"))
            for name in _TIMES
        }
        | {"_list": F.try_variant_get("_v_violations", "$", "array<variant>")}
    )
    version = F.col("_v_schema_version")
    version_text = F.when(
        F.coalesce(F.col("_k_schema_version"), F.lit("null")) == "null", "None"
    ).otherwise(display(version))
    judged = opened.withColumns({
        "_version": typed(version, "number"),
        "_error": F.coalesce(*(_field_error(n) for n in FIELDS if n != "schema_version")),
    })
    reason = (
        F.when(~F.col("_is_json"), "invalid_json")
        .when(~F.col("_is_object"), "not_an_object")
        .when(
            ~F.coalesce(F.col("_version") == MESSAGE_VERSION, F.lit(False)),
            F.concat(F.lit("unsupported_schema_version:"), version_text),
        )
        .when(F.col("_error").isNotNull(), F.concat(F.lit("invalid_message:"), "_error"))
    )
    none = F.array().cast("array<string>")
    texts = F.transform("_list", lambda v: F.try_variant_get(v, "$", "string"))
    finished = judged.select(
        "project_id",
        "event_id",
        F.col("_s_event").alias("event"),
        F.col("_s_distinct_id").alias("distinct_id"),
        F.col("_s_user_id").alias("user_id"),
        F.col("_s_anonymous_id").alias("anonymous_id"),
        millis("timestamp").alias("timestamp"),
        millis("client_timestamp").alias("client_timestamp"),
        millis("received_at").alias("received_at"),
        F.to_json("_v_properties").alias("properties"),
        F.to_json("_v_context").alias("context"),
        F.col("_s_ip").alias("ip"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.coalesce(texts, none).alias("violations"),
        reason.alias("reason"),
        "key",
        "value",
        "topic",
    )
    return finished.select(whole_rows(*finished.columns))


def event_rows(parsed: DataFrame) -> DataFrame:
    """The messages that are event rows."""
    return parsed.filter(F.col("reason").isNull()).drop("reason", "key", "value", "topic")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """The messages that are not, with their original bytes and where they came from."""
    return parsed.filter(F.col("reason").isNotNull()).select(
        "value",
        "key",
        "reason",
        F.col("topic").alias("source_topic"),
        F.col("kafka_partition").alias("source_partition"),
        F.col("kafka_offset").alias("source_offset"),
    )
