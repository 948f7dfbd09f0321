"""The ingest stream: parse, drop repeated ids, store rows, keep dead letters, link identities.

Spark commits a micro-batch only after ``foreachBatch`` returns, and every write below owns
directories named after its batch, so a crash at any point replays the batch onto itself.

A micro-batch may have any size: what several writes need of it is staged as files, not kept in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from footfall.operators.dedup import drop_recently_stored, first_in_batch, remembered_ids
from footfall.operators.identity import identity_links
from footfall.plans import limits
from footfall.schemas import DEAD_LETTERS, EVENTS
from footfall.session import DEFAULTS
from footfall.sources.events import child_dirs, delete_dir, write_events
from footfall.sources.links import compact_links, read_links
from footfall.streaming.messages import dead_letters, event_rows, parse_messages
from footfall.streaming.seen import flag_copies

IDS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("stored_at", T.TimestampType()),
    T.StructField("hour", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])
PROGRESS = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("consumed", T.LongType()),
    T.StructField("dropped", T.LongType()),
])
REPORT = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("consumed", T.LongType()),
    T.StructField("inserted", T.LongType()),
    T.StructField("duplicates", T.LongType()),
    T.StructField("dead_lettered", T.LongType()),
])

#: Row groups of staged files have about so many bytes; a task holds one of them.
STAGE_BYTES = 16 << 20


@dataclass(frozen=True)
class Store:
    """Where the stream keeps its tables; ``root`` must be reachable by every executor."""

    root: str

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def links(self) -> str:
        return f"{self.root}/identity_links"

    @property
    def stored_ids(self) -> str:
        return f"{self.root}/stored_ids"

    @property
    def report(self) -> str:
        return f"{self.root}/batch_report"

    @property
    def progress(self) -> str:
        return f"{self.root}/batch_progress"

    @property
    def staging(self) -> str:
        return f"{self.root}/staging"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"

    def read(self, spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
        """A table of the store; empty before its first write."""
        try:
            return spark.read.schema(schema).parquet(path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return spark.createDataFrame([], schema)


def drop_seen_ids(parsed: DataFrame, window: str = limits.DEDUP_WINDOW) -> DataFrame:
    """Streaming dedup in the state store, by time of arrival.

    The clock is the start of the micro-batch, so no row is ever late and none is discarded. An
    id is remembered for at least ``window`` and at most twice as long, counted from when it was
    stored. Of copies within one micro-batch any one stays. Dead letters get ids of their own
    and all pass.
    """
    place = F.concat_ws("/", F.lit("letter"), "topic", "kafka_partition", "kafka_offset")
    identity = F.when(F.col("reason").isNull(), F.concat_ws("/", "project_id", "event_id"))
    marked = parsed.withColumns({
        "_identity": F.coalesce(identity, place),
        "_arrived": F.current_timestamp(),
    })
    unique = marked.withWatermark("_arrived", window).dropDuplicatesWithinWatermark(["_identity"])
    return unique.drop("_identity", "_arrived")


def _overwrite(rows: DataFrame, path: str, *partitions: str) -> None:
    writer = rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.partitionBy(*partitions).parquet(path)


def _staged(rows: DataFrame, path: str) -> DataFrame:
    """The rows, computed once and read from files from then on.

    Neither side holds more than a row group, nor needs the executor that wrote it. (Cached blocks go to disk when memory is
    short, but Java's streams hold on to the last hundred column batches of each block they write or read.) Times are
    numbers in the files: Parquet refuses some early ones, and a dead letter may have any.
    """
    times = [f.name for f in rows.schema if isinstance(f.dataType, T.TimestampType)]
    plain = rows.withColumns({name: F.unix_micros(name) for name in times})
    plain.write.mode("overwrite").option("parquet.block.size", STAGE_BYTES).parquet(path)
    read = rows.sparkSession.read.schema(plain.schema).parquet(path)
    return read.withColumns({name: F.timestamp_micros(name) for name in times})


LetterSink = Callable[[DataFrame, int], None]


def store_batch(
    parsed: DataFrame,
    batch_id: int,
    store: Store,
    exact_window: str | None,
    letter_sink: LetterSink | None = None,
) -> None:
    """Store one micro-batch of parsed messages; repeating it changes nothing.

    With ``exact_window`` repeated ids are dropped here, against the ids stored in the window
    before now; the first copy in log order stays. Rows whose ``copies`` is above zero are no
    messages but count those the state left out. Dead letters go to the store, or to
    ``letter_sink(letters, batch_id)``, which must be done with them when it returns.
    """
    spark = parsed.sparkSession
    now = datetime.now(UTC)
    staging = f"{store.staging}/{batch_id}"
    try:
        parsed = _staged(parsed, f"{staging}/parsed")
        copies = F.col("copies") if "copies" in parsed.columns else F.lit(0)
        totals = parsed.agg(
            F.coalesce(F.sum(F.greatest(copies, F.lit(1))), F.lit(0)).alias("consumed"),
            F.count("reason").alias("dead_lettered"),
        ).first()
        if not totals["consumed"]:  # a micro-batch that only moves the watermark
            return
        if "copies" in parsed.columns:
            parsed = parsed.filter("copies = 0").drop("copies")
        rows = event_rows(parsed)
        if exact_window is not None:
            ids = store.read(spark, store.stored_ids, IDS).filter(F.col("batch_id") != batch_id)
            oldest = F.date_format(F.lit(now) - F.expr(f"interval {exact_window}"), "yyyyMMddHH")
            ids = ids.filter(F.col("hour") >= oldest)
            rows = drop_recently_stored(first_in_batch(rows), ids, F.lit(now), exact_window)
            rows = _staged(rows, f"{staging}/rows")
        # Links, ids and counts come from the rows that are written: what becomes of the stored
        # files meanwhile (compaction, retention) can't take anything from them.
        rows = rows.withColumn("ingested_at", F.lit(now))
        write_events(rows, store.events, batch_id)
        inserted = rows.count()
        if inserted:
            links = identity_links(rows).withColumn("batch_id", F.lit(batch_id))
            _overwrite(links, store.links, "batch_id")
            if exact_window is not None:
                ids = remembered_ids(rows, F.lit(now)).withColumns({
                    "hour": F.date_format("stored_at", "yyyyMMddHH"),
                    "batch_id": F.lit(batch_id),
                })
                _overwrite(ids, store.stored_ids, "hour", "batch_id")

        letters = dead_letters(parsed).withColumns({
            "failed_at": F.lit(now),
            "batch_id": F.lit(batch_id),
        })
        if letter_sink is None:
            _overwrite(letters, store.dead_letters, "batch_id")
        elif totals["dead_lettered"]:
            letter_sink(letters, batch_id)

        consumed, dead = totals
        counts = (batch_id, consumed, inserted, consumed - inserted - dead, dead)
        report = spark.createDataFrame([counts], REPORT)
        _overwrite(report, store.report, "batch_id")
    finally:
        delete_dir(spark, staging)


class ProgressTable(StreamingQueryListener):
    """Keeps what the state-store dedup read and dropped: one row for each micro-batch of a store.

    A micro-batch of copies alone reaches no sink, but it makes progress.
    """

    def __init__(self, spark: SparkSession, store: Store, name: str):
        self.spark, self.store, self.name, self.run = spark, store, name, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name or not progress.numInputRows:
            return
        dropped = sum(o.customMetrics.get("numDroppedDuplicateRows", 0) for o in progress.stateOperators)
        row = [(progress.batchId, progress.numInputRows, dropped)]
        _overwrite(self.spark.createDataFrame(row, PROGRESS), self.store.progress, "batch_id")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.spark.streams.removeListener(self)


_STATE = "spark.sql.streaming.stateStore"
#: Keyed state needs RocksDB, and has a micro-batch without data follow every other one unless that is turned off
#: (expired ids don't need it: they are never read).
_KEYED = {
    f"{_STATE}.providerClass": DEFAULTS[f"{_STATE}.providerClass"],
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Ids of the state-store dedup. Spark's default store has every one of them on the heap of an executor; RocksDB has them on
#: disk, but each partition its own buffers, which are counted together here.
_UNIQUE = {
    f"{_STATE}.providerClass": DEFAULTS[f"{_STATE}.providerClass"],
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "256",
}


def _millis(spark: SparkSession, window: str) -> int:
    span = F.expr(f"timestamp_millis(0) + interval {window}")
    return spark.range(1).select(F.unix_millis(span)).first()[0]


@contextmanager
def _state_settings(spark: SparkSession, wanted: dict[str, str] = _KEYED) -> Iterator[None]:
    """A query takes the settings over when it starts."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def start_stream(
    raw: DataFrame,
    store: Store,
    dedup: str = "ttl",
    window: str = limits.DEDUP_WINDOW,
    available_now: bool = False,
    interval: str = "10 seconds",
    letter_sink: LetterSink | None = None,
    links_every: int = 50,
) -> StreamingQuery:
    """Start (or, with the same store, resume) the ingest stream.

    ``dedup="ttl"`` keeps ids in the state store and forgets each one exactly ``window`` after it was
    stored; the first copy in log order stays, a micro-batch costs what its own rows and the ids
    in their buckets cost, and copies are counted in the micro-batch that reads them. ``dedup="exact"`` decides the same
    from a table of stored ids by hour that each micro-batch joins: no Python, but its cost grows
    with the window. ``dedup="state"`` needs no Python either and costs what the new rows cost, but it
    keeps any copy of a micro-batch and remembers an id for up to twice the window; the rows it
    drops are kept in the progress table of the store.

    Every ``links_every`` micro-batches the links found since are merged into the buckets of the link table.
    """
    if dedup not in ("ttl", "state", "exact"):
        raise ValueError(f"unknown dedup '{dedup}'")
    parsed = parse_messages(raw)
    if dedup == "ttl":
        parsed = flag_copies(parsed, _millis(raw.sparkSession, window))
    elif dedup == "state":
        parsed = drop_seen_ids(parsed, window)
    exact = window if dedup == "exact" else None

    def store_and_tidy(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, store, exact, letter_sink)
        if (batch_id + 1) % links_every == 0:
            compact_links(batch.sparkSession, store.links, batch_id)

    writer = parsed.writeStream.foreachBatch(store_and_tidy).option("checkpointLocation", store.checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    if dedup == "ttl":
        with _state_settings(raw.sparkSession):
            return writer.trigger(**trigger).start()
    if dedup == "exact":
        return writer.trigger(**trigger).start()
    name = f"ingest-{uuid.uuid4().hex}"
    raw.sparkSession.streams.addListener(ProgressTable(raw.sparkSession, store, name))
    with _state_settings(raw.sparkSession, _UNIQUE):
        return writer.queryName(name).trigger(**trigger).start()


def committed_batch(spark: SparkSession, store: Store) -> int:
    """The last micro-batch whose every write is done; -1 before the first. Its number bounds
    what compaction may touch."""
    last = store.read(spark, store.report, REPORT).agg(F.max("batch_id")).first()[0]
    return -1 if last is None else last


def forget_ids(spark: SparkSession, store: Store, before: datetime) -> list[str]:
    """Remove the hours of the stored-id table that ended before ``before``."""
    hours = child_dirs(spark, store.stored_ids, "hour=")
    old = {hour: path for hour, path in hours.items() if hour < f"{before.astimezone(UTC):%Y%m%d%H}"}
    for path in old.values():
        delete_dir(spark, path)
    return sorted(old)


def stored_links(spark: SparkSession, store: Store) -> DataFrame:
    """The links found so far, each pair once."""
    return read_links(spark, store.links)


def stored_letters(spark: SparkSession, store: Store) -> DataFrame:
    return store.read(spark, store.dead_letters, DEAD_LETTERS)


def batch_report(spark: SparkSession, store: Store) -> DataFrame:
    """``batch_id, consumed, inserted, duplicates, dead_lettered`` per micro-batch that read rows.

    What the state-store dedup dropped before the sink is added from the progress table, for
    micro-batches of copies alone as well.
    """
    report = store.read(spark, store.report, REPORT)
    progress = store.read(spark, store.progress, PROGRESS).withColumnRenamed("consumed", "_read")
    zero = F.lit(0).cast("long")
    return report.join(progress, "batch_id", "full").select(
        "batch_id",
        F.coalesce("_read", "consumed").alias("consumed"),
        F.coalesce("inserted", zero).alias("inserted"),
        (F.coalesce("duplicates", zero) + F.coalesce("dropped", zero)).alias("duplicates"),
        F.coalesce("dead_lettered", zero).alias("dead_lettered"),
    )


def report_from_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Input rows and state-store duplicates of the recent micro-batches, and the log offsets
    for ``offsets_from_progress``; one row per micro-batch."""
    schema = "batch_id bigint, consumed bigint, duplicates bigint, end_offset string, latest_offset string"
    rows = []
    for progress in query.recentProgress:
        dropped = sum(
            operator.customMetrics.get("numDroppedDuplicateRows", 0)
            for operator in progress.stateOperators
        )
        source = progress.sources[0]
        rows.append(
            (progress.batchId, progress.numInputRows, dropped, source.endOffset, source.latestOffset)
        )
    return spark.createDataFrame(rows, schema)
