"""The stored tracking plans with several writers.

Layout: ``<path>/write=<id>`` holds the decisions of one writer, ``<path>/commit-<n>.json`` names the n-th write that counts.
A writer decides on what the commits so far hold and then claims the next number; of two writers one gets it, and the other
decides again on what is stored by then.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.tracking_plan import next_versions
from footfall.schemas import TRACKING_PLANS
from footfall.sources.events import delete_dir


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Directories of the writes that count, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("commit-")]
    if not found:
        return []
    texts = spark.read.text([p.toString() for p in found], wholetext=True).collect()  # one a saved proposal of plans
    commits = sorted((c["number"], c["write"]) for c in (json.loads(r[0]) for r in texts))
    return [f"{path}/write={write}" for _, write in commits]


def _claim(spark: SparkSession, path: str, number: int, write: str) -> bool:
    """Whether this write got the number: the file appears complete and only where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = spark._jvm.org.apache.hadoop.fs.Path(folder, f"_draft-{write}")
    final = spark._jvm.org.apache.hadoop.fs.Path(folder, f"commit-{number}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"number": number, "write": write}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        return False
    return True


def _read(spark: SparkSession, writes: list[str]) -> DataFrame:
    if not writes:
        return spark.createDataFrame([], TRACKING_PLANS)
    stored = spark.read.parquet(*writes).filter(F.col("status") == "saved")
    return stored.select(*TRACKING_PLANS.fieldNames())


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """All saved versions."""
    return _read(spark, _commits(spark, path))


def save_plans(proposed: DataFrame, path: str, attempts: int = 10) -> DataFrame:
    """Decide on proposed plans (see ``next_versions``) and store those that are saved; returns the decisions.

    A project whose next version another writer took since the first decision gets the status ``version_taken`` and is not
    saved; the other projects are. Gives up after ``attempts`` lost claims.
    """
    spark = proposed.sparkSession
    first = None
    for _ in range(attempts):
        before = _commits(spark, path)
        decided = next_versions(_read(spark, before), proposed)
        if first is not None:
            asked = first.groupBy("project_id").agg(F.max("version").alias("asked"))
            taken = (F.col("status") == "saved") & (F.col("version") != F.col("asked"))
            decided = decided.join(asked, "project_id").withColumn(
                "status", F.when(taken, "version_taken").otherwise(F.col("status"))
            )
            decided = decided.drop("asked")
        write = uuid.uuid4().hex
        target = f"{path}/write={write}"
        decided.write.parquet(target)
        made = spark.read.schema(decided.schema).parquet(target)
        if _claim(spark, path, len(before) + 1, write):
            return made
        first = made if first is None else first
    raise RuntimeError(f"no claim on {path} in {attempts} attempts")


def remove_lost_writes(spark: SparkSession, path: str, writes: list[str]) -> None:
    """Remove directories (names of ``write=``) that lost their claim; those that count are left alone."""
    counted = set(_commits(spark, path))
    for write in writes:
        if f"{path}/write={write}" not in counted:
            delete_dir(spark, f"{path}/write={write}")
