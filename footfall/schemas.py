"""Schemas of the stored tables and of the message formats."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("project_id", T.StringType(), False),
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("distinct_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("anonymous_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("client_timestamp", T.TimestampType()),
    T.StructField("received_at", T.TimestampType(), False),
    T.StructField("properties", T.StringType(), False),
    T.StructField("context", T.StringType(), False),
    T.StructField("ip", T.StringType()),
    T.StructField("kafka_partition", T.IntegerType()),
    T.StructField("kafka_offset", T.LongType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("violations", T.ArrayType(T.StringType())),
])

# Partition columns of the stored table: month of the event, then the write that made the file.
EVENT_PARTITIONS = T.StructType([
    T.StructField("month", T.StringType()),
    T.StructField("batch_id", T.StringType()),
])

IDENTITY_LINKS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("anonymous_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("linked_at", T.TimestampType()),
])

RAW_BATCHES = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("ip", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("batch", T.ArrayType(T.StringType())),
])

RAW_MESSAGES = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])

DEAD_LETTERS = T.StructType([
    T.StructField("value", T.BinaryType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("reason", T.StringType()),
    T.StructField("source_topic", T.StringType()),
    T.StructField("source_partition", T.IntegerType()),
    T.StructField("source_offset", T.LongType()),
    T.StructField("failed_at", T.TimestampType()),
])

PROPERTY_SPEC = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("required", T.BooleanType()),
    T.StructField("enum", T.ArrayType(T.VariantType())),
])
EVENT_SPEC = T.StructType([
    T.StructField("additional_properties", T.BooleanType()),
    T.StructField("properties", T.MapType(T.StringType(), PROPERTY_SPEC)),
])
PLAN = T.StructType([
    T.StructField("enforcement", T.StringType()),
    T.StructField("allow_unplanned_events", T.BooleanType()),
    T.StructField("events", T.MapType(T.StringType(), EVENT_SPEC)),
])
TRACKING_PLANS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("plan", PLAN),
])
