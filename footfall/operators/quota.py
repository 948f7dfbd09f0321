"""Quota usage: how full each project's token bucket was after every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.plans import limits


def quota_usage(
    batches: DataFrame,
    rate: float = limits.QUOTA_EVENTS_PER_SECOND,
    burst: int = limits.QUOTA_BURST,
    chunk_seconds: int = 60,
) -> DataFrame:
    """Add ``depth`` (events charged and not yet drained, this batch included) and ``exceeded``.

    Takes ``project_id, batch_id, received_at, cost``. A report: the demand of a flagged batch
    still counts. With X = events so far - rate * time, depth = X - min over X before each
    charge.

    A running value over a whole project would put it into one task. So the sums run in three
    steps, each over a bounded group: batches within one millisecond, milliseconds within one
    chunk, chunks within the project. Costs are not negative, so within a millisecond X is
    lowest before its first charge.
    """
    instant, chunk = ["project_id", "_ms"], ["project_id", "_chunk"]
    rows = batches.withColumn("_ms", F.unix_millis("received_at"))
    in_order = Window.partitionBy(*instant).orderBy("batch_id")
    rows = rows.withColumn(
        "_sum", F.sum("cost").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    instants = rows.groupBy(*instant).agg(F.sum("cost").alias("_cost"))

    # Milliseconds from a fixed origin keep the products small enough to be exact.
    origin_ms = 1_600_000_000_000
    within = Window.partitionBy(*chunk).orderBy("_ms").rowsBetween(Window.unboundedPreceding, 0)
    instants = (
        instants.withColumn("_chunk", F.floor(F.col("_ms") / (chunk_seconds * 1000)))
        .withColumn("_drained", (F.col("_ms") - origin_ms) / 1000.0 * rate)
        .withColumn("_before", F.sum("_cost").over(within) - F.col("_cost"))
        .withColumn("_low", F.min(F.col("_before") - F.col("_drained")).over(within))
    )

    earlier = (
        Window.partitionBy("project_id")
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    chunks = instants.groupBy(*chunk).agg(
        F.sum("_cost").alias("_chunk_cost"), F.min("_low").alias("_chunk_low")
    )
    chunks = chunks.withColumn("_carried", F.coalesce(F.sum("_chunk_cost").over(earlier), F.lit(0)))
    chunks = chunks.withColumn(
        "_earlier_low", F.min(F.col("_chunk_low") + F.col("_carried")).over(earlier)
    ).select(*chunk, "_carried", "_earlier_low")

    low = F.least(F.col("_earlier_low"), F.col("_carried") + F.col("_low"))
    level = F.col("_carried") + F.col("_before") - F.col("_drained")
    above = instants.join(chunks, chunk).select(*instant, (level - low).alias("_above"))
    depth = F.round(F.col("_above") + F.col("_sum"), 3)
    return (
        rows.join(above, instant)
        .select("project_id", "batch_id", "received_at", "cost", depth.alias("depth"))
        .withColumn("exceeded", F.col("depth") > burst)
    )


def batch_costs(batches: DataFrame) -> DataFrame:
    """What each batch is charged: its number of events."""
    return batches.select(
        "project_id", "batch_id", "received_at", F.size("batch").cast("bigint").alias("cost")
    )
