"""How often does an event happen: counts or persons per time bucket, optionally by property."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.props import Properties, matches_all
from footfall.functions.timebuckets import bucket, bucket_starts
from footfall.operators.identity import by_person, first_links, link_rows, resolve
from footfall.operators.scope import Dedup, current_rows
from footfall.plans.requests import SegmentationQuery

OTHER = "$other"
NONE = "$none"


def segment_counts(
    events: DataFrame,
    project_id: str,
    query: SegmentationQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
    approximate: bool = False,
) -> DataFrame:
    """``bucket, segment, value``, without empty buckets; segment is '' without a breakdown.

    ``total`` counts events and needs no identities. ``unique_users`` counts persons exactly,
    or with ``approximate`` by a sketch of about 1 % error.
    """
    properties = Properties(f.property for f in query.filters)
    segment = F.lit("")
    if query.breakdown:
        segment = F.coalesce(F.nullif(properties.display(query.breakdown), F.lit("")), F.lit(NONE))
    carry = {"bucket": bucket("timestamp", query.interval), "segment": segment}
    if query.filters:
        carry["_matches"] = matches_all(query.filters, properties)
    rows = current_rows(
        events, project_id, query.start, query.end, [query.event], dedup, carry
    )
    if query.filters:
        rows = rows.filter("_matches")
    keys = ["bucket", "segment"]
    if query.measure == "total":
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))
    first = first_links(link_rows(events) if links is None else links, project_id)
    if approximate:
        persons = resolve(rows, first, keys, {})
        return persons.groupBy(*keys).agg(
            F.approx_count_distinct("person_id", 0.01).alias("value")
        )
    persons = by_person(rows, first, keys, {})
    return persons.groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))


def fold_tail(counts: DataFrame, keep: int) -> DataFrame:
    """Keep the ``keep`` segments with the highest totals, sum all others into ``$other``.

    Returns ``rank, segment, bucket, value``; ``$other`` ranks last. The broadcast side has at
    most ``keep`` (<= 1,000) rows; the counts feed both branches from one shuffle.
    """
    totals = counts.groupBy("segment").agg(F.sum("value").alias("total"))
    leaders = totals.orderBy(F.desc("total"), "segment").limit(keep)
    by_total = Window.orderBy(F.desc("total"), "segment")  # over at most `keep` rows
    leaders = leaders.select("segment", F.row_number().over(by_total).alias("rank"))
    marked = counts.join(F.broadcast(leaders), "segment", "left")
    return (
        marked.withColumn("segment", F.when(F.col("rank").isNull(), OTHER).otherwise(F.col("segment")))
        .withColumn("rank", F.coalesce("rank", F.lit(keep + 1)))
        .groupBy("rank", "segment", "bucket")
        .agg(F.sum("value").alias("value"))
    )


def segmentation(
    events: DataFrame,
    project_id: str,
    query: SegmentationQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
    approximate: bool = False,
) -> DataFrame:
    """The full series: ``rank, segment, bucket, value, total``, every bucket present.

    ``segment`` is NULL without a breakdown. ``total`` sums the buckets, so for unique users
    it is a sum of per-bucket uniques. A breakdown that matches nothing still gives one series
    of zeros, labelled ''.
    """
    counts = segment_counts(events, project_id, query, links, dedup, approximate)
    if query.breakdown:
        points = fold_tail(counts, query.breakdown_limit)
    else:
        points = counts.withColumn("rank", F.lit(1))
    # A row without a bucket in the first series: it stands alone, with the least label, where nothing matches.
    blank = events.sparkSession.range(0, 1, 1, 1).select(
        F.lit(1).alias("rank"),
        F.lit("").alias("segment"),
        F.lit(None).cast("timestamp").alias("bucket"),
        F.lit(0).cast("bigint").alias("value"),
    )
    point = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "value"))
    # A rank has one segment. At most breakdown_limit + 1 series of at most 1,000 buckets from here on.
    series = points.unionByName(blank).groupBy("rank").agg(
        F.max("segment").alias("segment"),
        F.map_from_entries(F.collect_list(point)).alias("points"),
        F.sum("value").alias("total"),
    )
    dense = series.withColumn("bucket", F.explode(bucket_starts(query.start, query.end, query.interval)))
    return dense.select(
        "rank",
        F.col("segment") if query.breakdown else F.lit(None).cast("string").alias("segment"),
        "bucket",
        F.coalesce(F.try_element_at("points", F.col("bucket")), F.lit(0)).alias("value"),
        "total",
    )
