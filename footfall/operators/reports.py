"""Operational reports over stored events, dead letters and stream offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.scalars import histogram_edge
from footfall.plans import limits


def freshness_histogram(
    events: DataFrame, edges: tuple[float, ...] = limits.FRESHNESS_EDGES
) -> DataFrame:
    """``edge, events, cumulative``: seconds from receipt to storage, every edge present."""
    delay = (F.unix_micros("ingested_at") - F.unix_micros("received_at")) / 1e6
    counted = events.groupBy(histogram_edge(delay, edges).alias("edge")).agg(
        F.count(F.lit(1)).alias("events")
    )
    every = F.array(*(F.lit(float(e)) for e in (*edges, float("inf"))))
    spine = events.sparkSession.range(1).select(F.explode(every).alias("edge"))
    # Eleven rows on either side.
    dense = spine.join(F.broadcast(counted), "edge", "left").fillna(0, ["events"])
    up_to = Window.orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("cumulative", F.sum("events").over(up_to))


def freshness_quantiles(
    events: DataFrame,
    quantiles: Sequence[float] = (0.5, 0.95, 0.99),
    edges: tuple[float, ...] = limits.FRESHNESS_EDGES,
) -> DataFrame:
    """``quantile, seconds``, interpolated inside the histogram bucket that holds the rank; the
    last finite edge when it lies above."""
    in_order = Window.orderBy("edge")
    buckets = freshness_histogram(events, edges).select(
        "edge",
        "events",
        "cumulative",
        F.lag("edge", 1, 0.0).over(in_order).alias("lower"),
        F.max("cumulative").over(Window.partitionBy()).alias("total"),
    )
    wanted = F.array(*(F.lit(float(q)) for q in quantiles))
    ranked = buckets.withColumn("quantile", F.explode(wanted)).withColumn(
        "rank", F.col("quantile") * F.col("total")
    )
    inside = (F.col("events") > 0) & (F.col("cumulative") >= F.col("rank"))
    share = (F.col("rank") - (F.col("cumulative") - F.col("events"))) / F.col("events")
    seconds = F.when(F.col("edge") == float("inf"), F.col("lower")).otherwise(
        F.col("lower") + (F.col("edge") - F.col("lower")) * share
    )
    holding = ranked.filter(inside).withColumn("seconds", seconds)
    return holding.groupBy("quantile").agg(F.min_by("seconds", "edge").alias("seconds"))


def dead_letter_report(letters: DataFrame, window: str = "10 minutes") -> DataFrame:
    """``window_start, reason, letters``: by the kind of reason (the text before the first colon)."""
    return letters.groupBy(
        F.window("failed_at", window).getField("start").alias("window_start"),
        F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason"),
    ).agg(F.count(F.lit(1)).alias("letters"))


def backlog(end_offsets: DataFrame, positions: DataFrame) -> DataFrame:
    """``topic, partition, behind``: records not read yet, never negative.

    Both inputs hold ``topic, partition, offset`` of the next record; a partition without a
    position counts from 0.
    """
    ends = end_offsets.withColumnRenamed("offset", "end")
    at = positions.withColumnRenamed("offset", "position")
    behind = F.greatest(F.col("end") - F.coalesce("position", F.lit(0)), F.lit(0))
    return ends.join(at, ["topic", "partition"], "left").select(
        "topic", "partition", behind.alias("behind")
    )


def total_backlog(per_partition: DataFrame) -> DataFrame:
    return per_partition.agg(F.coalesce(F.sum("behind"), F.lit(0)).alias("behind"))


def offsets_from_progress(progress: DataFrame, column: str) -> DataFrame:
    """``topic, partition, offset`` from the offset JSON of streaming progress
    (``{"topic": {"0": 12}}``), as in ``latestOffset`` and ``endOffset``."""
    per_topic = progress.select(
        F.explode(F.from_json(column, "map<string,map<string,bigint>>")).alias("topic", "offsets")
    )
    return per_topic.select("topic", F.explode("offsets").alias("partition", "offset")).withColumn(
        "partition", F.col("partition").cast("int")
    )
