"""Tables an operator writes into the shared folder on its way, and removes once they are superseded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from footfall.session import shared_dir
from footfall.sources.events import delete_dir


class Scratch:
    """Saved tables of one run. Saving ends the lineage, so lost executors cost one step at most."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes saved tables no later step reads; others are ignored."""
        for table in tables:
            if table is not None and id(table) in self._paths:
                delete_dir(self.spark, self._paths[id(table)][1])
                self._paths[id(table)] = (table, "")
