"""Numbered states of a table: ``manifest-<n>.json`` appears under its name at once, is never changed, and each number is
taken once, so a reader sees one state or the next and of two writers one has to begin again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def manifests(spark: SparkSession, folder: str) -> dict[int, str]:
    """Number and path of each state that is still there."""
    fs, root = file_system(spark, folder)
    if not fs.exists(root):
        return {}
    names = [status.getPath() for status in fs.listStatus(root)]
    return {
        int(p.getName()[len("manifest-") : -len(".json")]): p.toString()
        for p in names
        if p.getName().startswith("manifest-") and p.getName().endswith(".json")
    }


def load(spark: SparkSession, files: list[str]) -> list[dict]:
    """What the manifests say, in no particular order; one job for all."""
    return [json.loads(r[0]) for r in spark.read.text(files, wholetext=True).collect()] if files else []


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Whether this content took the number; another writer may have been first."""
    fs, root = file_system(spark, folder)
    draft = spark._jvm.org.apache.hadoop.fs.Path(root, f"_draft-{uuid.uuid4().hex}")
    final = spark._jvm.org.apache.hadoop.fs.Path(root, f"manifest-{number}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        return False
    return True
