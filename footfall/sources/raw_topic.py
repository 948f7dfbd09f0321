"""The raw event log: Kafka, or a directory with the same records as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.plans import limits
from footfall.schemas import RAW_MESSAGES


def read_raw_stream(
    spark: SparkSession,
    *,
    servers: str | None = None,
    topic: str = "events.raw",
    path: str | None = None,
    file_format: str = "json",
    max_records: int = limits.MAX_RECORDS_PER_TRIGGER,
    max_files: int | None = None,
) -> DataFrame:
    """``key, value, topic, partition, offset`` as a stream, from the earliest record on.

    Kafka when ``servers`` is given (needs the Kafka connector package), else files under
    ``path``; JSON files hold key and value in base64.
    """
    if servers is not None:
        stream = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", max_records)
            .load()
        )
    elif path is not None:
        reader = spark.readStream.schema(RAW_MESSAGES)
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        stream = reader.format(file_format).load(path)
    else:
        raise ValueError("name Kafka servers or a path")
    return stream.select(*RAW_MESSAGES.fieldNames())


def kafka_records(messages: DataFrame) -> DataFrame:
    """``key, value`` as the Kafka sink takes them. Its partitioner keeps a key, and so a user,
    on one partition."""
    return messages.select("key", "value")


def write_messages(
    messages: DataFrame,
    *,
    servers: str | None = None,
    topic: str = "events.raw",
    path: str | None = None,
    file_format: str = "json",
) -> None:
    """Append accepted messages to the log."""
    if servers is not None:
        records = kafka_records(messages).write.format("kafka")
        records.option("kafka.bootstrap.servers", servers).option("topic", topic).option(
            "kafka.acks", "all"
        ).save()
    elif path is not None:
        messages.write.mode("append").format(file_format).save(path)
    else:
        raise ValueError("name Kafka servers or a path")


def dead_letter_records(letters: DataFrame) -> DataFrame:
    """Dead letters in the form of the Kafka sink: original key and value, the rest as headers."""

    def header(name: str, column: str):
        return F.struct(
            F.lit(name).alias("key"), F.col(column).cast("string").cast("binary").alias("value")
        )

    return letters.select(
        "key",
        "value",
        F.array(
            header("error", "reason"),
            header("source_topic", "source_topic"),
            header("source_partition", "source_partition"),
            header("source_offset", "source_offset"),
        ).alias("headers"),
    )


def kafka_letter_sink(servers: str, topic: str = "events.dead") -> Callable[[DataFrame, int], None]:
    """A sink for ``start_stream`` that publishes dead letters. A replayed micro-batch publishes
    its letters again; consumers tell them by source topic, partition and offset."""

    def write(letters: DataFrame, batch_id: int) -> None:
        records = dead_letter_records(letters).write.format("kafka")
        records.option("kafka.bootstrap.servers", servers).option("topic", topic).option(
            "includeHeaders", "true"
        ).save()

    return write
