"""The stored events table: Parquet, partitioned by month and by the write that made it.

Layout: ``<path>/month=yyyyMM/batch_id=<write>/part-*.parquet``. A write owns its directories,
so repeating it (a replayed micro-batch) overwrites just them.

``<path>-state/month=yyyyMM`` holds the states of a month: a manifest names the result of the last
compaction, the files it replaced (hidden from then on, removed by the next compaction) and the
zone maps, which say for each file which projects, times and events it can hold. A directory
no manifest knows is a write since the last compaction and is read; a compaction that no manifest names is not.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Collection
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.operators.dedup import latest_rows
from footfall.schemas import EVENT_PARTITIONS, EVENTS
from footfall.sources.manifests import file_system, load, manifests, publish

COMPACTED = "compact-"
COLUMNS = EVENTS.fieldNames()
# Queries filter by project, then time, then event; the id makes ranges splittable anywhere.
SORT_KEY = ("project_id", "date", "event", "event_id")
#: A compaction cuts a month into files of about so many bytes.
FILE_BYTES = 512 << 20
#: Nor does it put more rows than about so many in a file: a task sorts them, and rows that compress well are far larger in memory.
FILE_ROWS = 2_000_000
#: A compaction that published nothing for so many hours is taken for dead and its files are removed.
DEAD_HOURS = 24


def month_of(timestamp: Column | str) -> Column:
    return F.date_format(timestamp, "yyyyMM")


def write_events(rows: DataFrame, path: str, batch_id: str | int) -> None:
    """Store one micro-batch. ``rebalance`` merges small and splits large partitions, so a
    month gets few files however skewed the batch is."""
    marked = rows.select(
        *COLUMNS, month_of("timestamp").alias("month"), F.lit(str(batch_id)).alias("batch_id")
    )
    (
        marked.hint("rebalance", "month")
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy("month", "batch_id")
        .parquet(path)
    )


def _sorted_by_key(rows: DataFrame, *lead: str, files: int | None = None) -> DataFrame:
    """Range-partition and sort, so each file covers a narrow part of the key and row-group
    statistics prune. Ranges are cut from a sample: a huge project spans many files."""
    dated = rows.withColumn("date", F.to_date("timestamp"))
    keys = [*lead, *SORT_KEY]
    ranges = dated.repartitionByRange(files, *keys) if files else dated.repartitionByRange(*keys)
    return ranges.sortWithinPartitions(*keys).drop("date")


def load_events(rows: DataFrame, path: str, batch_id: str) -> None:
    """Store a large batch (history, generated data) in sort-key order."""
    marked = rows.select(*COLUMNS, month_of("timestamp").alias("month"))
    (
        _sorted_by_key(marked, "month")
        .withColumn("batch_id", F.lit(batch_id))
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy("month", "batch_id")
        .parquet(path)
    )


def child_dirs(spark: SparkSession, path: str, prefix: str) -> dict[str, str]:
    """Directory listing ``{value: path}`` of one partition level; names only, no data."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return {}
    found = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(prefix):
            found[name[len(prefix) :]] = status.getPath().toString()
    return found


def delete_dir(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = file_system(spark, path)
    fs.delete(hadoop_path, True)


def _files(spark: SparkSession, directory: str) -> dict[str, int]:
    """Data files of a directory with their bytes; names that start with ``_`` or ``.`` are markers."""
    fs, root = file_system(spark, directory)
    if not fs.exists(root):
        return {}
    found = {s.getPath().getName(): s.getLen() for s in fs.listStatus(root)}
    return {name: size for name, size in found.items() if name[0] not in "_."}


def months(spark: SparkSession, path: str) -> list[str]:
    return sorted(child_dirs(spark, path, "month="))


@dataclass(frozen=True)
class MonthState:
    """State ``number`` of a month.

    ``live`` is the write of the last compaction, ``replaced`` the files it took the place of (by write), ``zones`` the
    writes each zone map covers.
    """

    month: str
    number: int = 0
    live: str | None = None
    replaced: dict[str, list[str]] = field(default_factory=dict)
    zones: dict[str, list[str]] = field(default_factory=dict)

    @property
    def indexed(self) -> set[str]:
        return {write for writes in self.zones.values() for write in writes}


def _state_dir(path: str, month: str) -> str:
    return f"{path}-state/month={month}"


def _states(spark: SparkSession, path: str, wanted: Collection[str]) -> dict[str, MonthState]:
    """The last state of each month."""
    newest = []
    for month in wanted:
        found = manifests(spark, _state_dir(path, month))
        if found:
            newest.append(found[max(found)])
    read = {content["month"]: MonthState(**content) for content in load(spark, newest)}
    return {month: read.get(month, MonthState(month)) for month in wanted}


def _publish(spark: SparkSession, path: str, state: MonthState) -> bool:
    return publish(spark, _state_dir(path, state.month), state.number, vars(state))


@dataclass(frozen=True)
class _Visible:
    """What a reader of a state sees of one write: its directory, or just some of its files."""

    directory: str
    files: list[str] | None = None

    @property
    def paths(self) -> list[str]:
        return [self.directory] if self.files is None else [f"{self.directory}/{f}" for f in self.files]


def _visible(spark: SparkSession, path: str, state: MonthState) -> dict[str, _Visible]:
    """By write. The state has to be read before the directories are listed: what a later compaction replaces is then still
    there, and its result is not known to this state."""
    found = {}
    for write, directory in child_dirs(spark, f"{path}/month={state.month}", "batch_id=").items():
        if write in state.replaced:
            # Written again since: what the compaction did not read is new.
            files = sorted(set(_files(spark, directory)).difference(state.replaced[write]))
            if files:
                found[write] = _Visible(directory, files)
        elif write == state.live or not write.startswith(COMPACTED):
            found[write] = _Visible(directory)
    return found


def _zone_rows(rows: DataFrame) -> DataFrame:
    """For each file of a scan the least and greatest project, time and event."""
    place = F.regexp_extract("_metadata.file_path", "batch_id=([^/]+/[^/]+)$", 1)
    # By project and event first: limits of times are aggregated in a hash table, those of texts would sort all rows.
    found = rows.groupBy(place.alias("file"), "project_id", "event").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    ranges = [
        fn(column).alias(f"{name}_{end}")
        for name, low, high in (("project", "project_id", "project_id"), ("time", "first", "last"), ("event", "event", "event"))
        for end, fn, column in (("lo", F.min, low), ("hi", F.max, high))
    ]
    return found.groupBy("file").agg(F.sum("rows").alias("rows"), *ranges)


def _write_zones(spark: SparkSession, path: str, month: str, directories: list[str]) -> str:
    """A zone map of all files in the directories (three columns are read); one row a file."""
    name = uuid.uuid4().hex
    zones = _zone_rows(spark.read.schema(EVENTS).parquet(*directories))
    zones.coalesce(1).write.parquet(f"{_state_dir(path, month)}/zones={name}")
    return name


def compact_month(
    spark: SparkSession, path: str, month: str, committed: int | None = None, file_bytes: int = FILE_BYTES
) -> str | None:
    """Make the read-time dedup of one month permanent, and put the month in sort-key order; returns the live write.

    Next to a running stream ``committed`` is the last micro-batch that is done
    (``streaming.job.committed_batch``); later ones are left out. Readers see the state before or the one after, never
    both: the result counts once its manifest is there. The files it replaces stay until the next compaction, for readers
    that began before. Of two compactions at once one is published. The number of files follows from the bytes read, and
    from the rows where they are many for their bytes.
    """
    before = _states(spark, path, [month])[month]
    _forget(spark, path, before)
    visible = {
        write: seen
        for write, seen in _visible(spark, path, before).items()
        if committed is None or not write.isdigit() or int(write) <= committed
    }
    sizes = {w: _files(spark, seen.directory) for w, seen in visible.items()}
    files = {w: seen.files or sorted(sizes[w]) for w, seen in visible.items()}
    if not any(files.values()) or set(visible) == {before.live}:
        return before.live
    size = sum(sizes[w][f] for w in files for f in files[w])
    rows = spark.read.schema(EVENTS).parquet(*(f"{visible[w].directory}/{f}" for w in files for f in files[w]))
    live = f"{COMPACTED}{uuid.uuid4().hex}"
    target = f"{path}/month={month}/batch_id={live}"
    count = max(1, math.ceil(size / file_bytes), math.ceil(rows.count() / FILE_ROWS))
    _sorted_by_key(latest_rows(rows).select(*COLUMNS), files=count).write.parquet(target)
    made = _write_zones(spark, path, month, [target])
    kept = {z: [w for w in writes if w not in files] for z, writes in before.zones.items()}
    zones = {z: writes for z, writes in kept.items() if writes} | {made: [live]}
    after = MonthState(month, before.number + 1, live, files, zones)
    if not _publish(spark, path, after):
        delete_dir(spark, target)
        delete_dir(spark, f"{_state_dir(path, month)}/zones={made}")
        return _states(spark, path, [month])[month].live
    return live


def index_month(spark: SparkSession, path: str, month: str, committed: int) -> MonthState:
    """Add a zone map of the micro-batches up to ``committed`` that have none, so that reads skip their files before the
    next compaction. Such micro-batches are never written again; other writes are read whole until they are compacted."""
    before = _states(spark, path, [month])[month]
    fresh = {
        write: seen.directory
        for write, seen in _visible(spark, path, before).items()
        if write.isdigit() and int(write) <= committed and write not in before.indexed and seen.files is None
    }
    if not fresh:
        return before
    made = _write_zones(spark, path, month, list(fresh.values()))
    after = replace(before, number=before.number + 1, zones=before.zones | {made: sorted(fresh)})
    if not _publish(spark, path, after):
        delete_dir(spark, f"{_state_dir(path, month)}/zones={made}")
        return _states(spark, path, [month])[month]
    return after


def _forget(spark: SparkSession, path: str, state: MonthState) -> None:
    """Remove what the state has hidden since it was published, older states, and what dead compactions left."""
    root = f"{path}/month={state.month}"
    for write, files in state.replaced.items():
        directory = f"{root}/batch_id={write}"
        for file in files:
            delete_dir(spark, f"{directory}/{file}")
        if not _files(spark, directory):
            delete_dir(spark, directory)
    for number, file in manifests(spark, _state_dir(path, state.month)).items():
        if number < state.number:
            delete_dir(spark, file)
    oldest = (datetime.now(UTC) - timedelta(hours=DEAD_HOURS)).timestamp() * 1000
    leftovers = [
        (f"{root}", "batch_id=", lambda w: w.startswith(COMPACTED) and w != state.live),
        (_state_dir(path, state.month), "zones=", lambda z: z not in state.zones),
    ]
    for folder, prefix, unused in leftovers:
        for name, directory in child_dirs(spark, folder, prefix).items():
            fs, hadoop_path = file_system(spark, directory)
            if unused(name) and 0 < fs.getFileStatus(hadoop_path).getModificationTime() < oldest:
                fs.delete(hadoop_path, True)


def _in_zone(
    project_id: str | None, start: datetime | None, end: datetime | None, event_names: Collection[str]
) -> Column:
    """Whether a file of this zone map row can hold rows of the query."""
    can = F.lit(True)
    if project_id is not None:
        can &= F.lit(project_id).between(F.col("project_lo"), F.col("project_hi"))
    if start is not None:
        can &= F.col("time_hi") >= F.lit(start)
    if end is not None:
        can &= F.col("time_lo") < F.lit(end)
    if event_names:
        names = F.array(*map(F.lit, sorted(event_names)))
        can &= F.exists(names, lambda e: e.between(F.col("event_lo"), F.col("event_hi")))
    return can


def open_events(
    spark: SparkSession,
    path: str,
    project_id: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    event_names: Collection[str] = (),
) -> tuple[DataFrame, list[str]]:
    """The table and its settled months, both of one state: a write that arrives in between
    is either in neither or keeps its month from counting as settled.

    With limits given, files whose zone map excludes them are not read, nor listed by Spark. The rows still have to be
    filtered, as each query does; limits of time should be whole days, as the read-time dedup works by day.
    """
    wanted = [m for m in months(spark, path) if _overlaps(m, start, end)]
    states = _states(spark, path, wanted)
    paths, settled, maps = [], [], []
    limited = project_id is not None or start is not None or end is not None or bool(event_names)
    for month, state in states.items():
        visible = _visible(spark, path, state)
        if state.live and set(visible) == {state.live}:
            settled.append(month)
        indexed = state.indexed if limited else set()
        paths += [p for write, seen in visible.items() if write not in indexed for p in seen.paths]
        if limited:
            maps += [(f"{_state_dir(path, month)}/zones={z}", month, set(visible)) for z in state.zones]
    if maps:
        seen = {month: writes for _, month, writes in maps}
        zones = spark.read.option("basePath", f"{path}-state").parquet(*(m[0] for m in maps))
        found = zones.where(_in_zone(project_id, start, end, event_names)).select("month", "file").collect()  # to be read
        paths += [
            f"{path}/month={month}/batch_id={file}"
            for month, file in ((str(r.month), r.file) for r in found)
            if file.split("/")[0] in seen[month]
        ]
    return _read(spark, path, paths), settled


def _overlaps(month: str, start: datetime | None, end: datetime | None) -> bool:
    first = f"{start.astimezone(UTC):%Y%m}" if start else month
    last = f"{end.astimezone(UTC) - timedelta(microseconds=1):%Y%m}" if end else month
    return first <= month <= last


def _read(spark: SparkSession, path: str, paths: list[str]) -> DataFrame:
    """Rows from before ``violations`` existed read an empty array."""
    schema = T.StructType(EVENTS.fields + EVENT_PARTITIONS.fields)
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", path).parquet(*paths)
    empty = F.array().cast("array<string>")
    return rows.withColumn("violations", F.coalesce("violations", empty))


def scan_events(spark: SparkSession, path: str, *limits, **named) -> DataFrame:
    """The table alone; limits as in ``open_events``."""
    return open_events(spark, path, *limits, **named)[0]


def settled_months(spark: SparkSession, path: str) -> list[str]:
    """Months that hold the result of one compaction and nothing written since: one copy per
    event. Known from names alone."""
    states = _states(spark, path, months(spark, path))
    return [m for m, state in states.items() if state.live and set(_visible(spark, path, state)) == {state.live}]


def drop_months_before(spark: SparkSession, path: str, oldest_kept: str) -> list[str]:
    """Retention: remove whole months older than ``oldest_kept`` (yyyyMM) without reading them."""
    dropped = {m: d for m, d in child_dirs(spark, path, "month=").items() if m < oldest_kept}
    for month, directory in dropped.items():
        delete_dir(spark, _state_dir(path, month))
        delete_dir(spark, directory)
    return sorted(dropped)
