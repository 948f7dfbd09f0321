"""The stored link table: hash buckets that a merge copies and replaces, and a part for each micro-batch since.

Layout: ``<path>/batch_id=<n>`` are the parts micro-batches write. ``<path>-merged/write=<id>/bucket=<k>`` are merged buckets,
and ``<path>-merged/manifest-<n>.json`` names the live directory of each bucket and the last micro-batch they hold. A
manifest appears under its name at once and is never changed, so a reader sees one state or the next. What a merge
supersedes stays until the merge after it, for readers that began before.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.identity import merge_links
from footfall.schemas import IDENTITY_LINKS
from footfall.sources.events import child_dirs, delete_dir
from footfall.sources.manifests import load, manifests, publish

BUCKETS = 64


@dataclass(frozen=True)
class Manifest:
    """State ``number`` of the merged table: micro-batches up to ``through`` are in ``buckets`` (bucket: directory)."""

    number: int = 0
    through: int = -1
    buckets: dict[str, str] = field(default_factory=dict)


def _folder(path: str) -> str:
    return f"{path}-merged"


def latest(spark: SparkSession, path: str) -> Manifest:
    found = manifests(spark, _folder(path))
    return Manifest(max(found), **load(spark, [found[max(found)]])[0]) if found else Manifest()


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> bool:
    """Whether this manifest took its number; another merge may have been first."""
    content = {"through": manifest.through, "buckets": manifest.buckets}
    return publish(spark, _folder(path), manifest.number, content)


def _parts(spark: SparkSession, path: str, after: int, through: int | None = None) -> dict[int, str]:
    found = {int(n): directory for n, directory in child_dirs(spark, path, "batch_id=").items()}
    return {n: d for n, d in found.items() if n > after and (through is None or n <= through)}


def _read(spark: SparkSession, directories: list[str]) -> DataFrame:
    if not directories:
        return spark.createDataFrame([], IDENTITY_LINKS)
    return spark.read.schema(IDENTITY_LINKS).parquet(*directories)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Each (project, anonymous id, user) once, with the time the pair was first seen.

    Where no part is newer than the last merge, the merged buckets are read as they are.
    """
    now = latest(spark, path)
    merged = _read(spark, list(now.buckets.values()))
    fresh = _parts(spark, path, now.through)
    return merge_links(merged, _read(spark, list(fresh.values()))) if fresh else merged


def compact_links(spark: SparkSession, path: str, committed: int, buckets: int = BUCKETS) -> Manifest:
    """Merge the parts of micro-batches up to ``committed`` into their buckets; untouched buckets stay as they are.

    One file a bucket. A merge that dies before its manifest leaves a directory no one reads; two merges at once publish one.
    """
    now = latest(spark, path)
    parts = _parts(spark, path, now.through, committed)
    if not parts:
        return now
    bucket = F.pmod(F.xxhash64("project_id", "anonymous_id"), F.lit(buckets)).cast("int")
    new = _read(spark, list(parts.values()))
    touched = [str(r[0]) for r in new.select(bucket.alias("bucket")).distinct().collect()]  # ``buckets`` at most
    old = _read(spark, [now.buckets[k] for k in touched if k in now.buckets])
    target = f"{_folder(path)}/write={uuid.uuid4().hex}"
    merged = merge_links(old, new).withColumn("bucket", bucket)
    merged.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(target)
    live = now.buckets | {k: f"{target}/bucket={k}" for k in touched}
    made = Manifest(now.number + 1, max(parts), live)
    if not _publish(spark, path, made):
        delete_dir(spark, target)
        return latest(spark, path)
    _forget(spark, path, now, made)
    return made


def _forget(spark: SparkSession, path: str, before: Manifest, now: Manifest) -> None:
    """Remove what neither the last two states nor their readers need."""
    for directory in _parts(spark, path, -1, before.through).values():
        delete_dir(spark, directory)
    for number, file in manifests(spark, _folder(path)).items():
        if number < before.number:
            delete_dir(spark, file)
    used = {*before.buckets.values(), *now.buckets.values()}
    for write in child_dirs(spark, _folder(path), "write=").values():
        for directory in child_dirs(spark, write, "bucket=").values():
            if not any(directory.endswith(u.split("-merged/")[-1]) for u in used):
                delete_dir(spark, directory)
