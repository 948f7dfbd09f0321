"""Do people come back: cohorts by first event, activity by period after it."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalars import rate
from footfall.functions.timebuckets import day_floor
from footfall.operators.identity import by_person, first_links, link_rows
from footfall.operators.scope import Dedup, current_rows
from footfall.plans.requests import RetentionQuery

_DAYS = {"day": 1, "week": 7}
_WORD = 64


def _first_period(query: RetentionQuery) -> datetime:
    day = day_floor(query.start.astimezone(UTC))
    return day - timedelta(days=day.weekday()) if query.period == "week" else day


def _cells(
    events: DataFrame, project_id: str, query: RetentionQuery, links: DataFrame | None, dedup: Dedup
) -> DataFrame:
    """``cohort, offset, users``; offset -1 holds the size of the cohort.

    One scan and one shuffle by person: each person is reduced to the number of its cohort
    period and a bitmap of its active periods (at most 418 days, seven words), both combined
    before the shuffle.
    """
    length = _DAYS[query.period]
    origin = _first_period(query)
    finish = query.end + timedelta(days=length * query.periods)
    names = {query.start_event, query.return_event} if query.return_event else ()
    rows = current_rows(events, project_id, query.start, finish, names, dedup)

    days = F.datediff(F.to_date("timestamp"), F.lit(origin.date()))
    period = F.floor(days / length).cast("int")
    periods = (finish - origin).days // length + 1
    words = [f"word_{i}" for i in range(-(-periods // _WORD))]

    starts = (F.col("event") == query.start_event) & (F.col("timestamp") < F.lit(query.end))
    active = F.col("event") == query.return_event if query.return_event else F.lit(True)
    rows = rows.withColumn("period", period).withColumns(
        {"cohort": F.when(starts, F.col("period"))}
        | {
            word: F.when(
                active & (F.floor(F.col("period") / _WORD) == i),
                F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("period") % _WORD),
            ).otherwise(F.lit(0).cast("bigint"))
            for i, word in enumerate(words)
        }
    )
    measures = {"cohort": F.min} | {word: F.bit_or for word in words}
    first = first_links(link_rows(events) if links is None else links, project_id)
    persons = by_person(rows, first, [], measures).filter(F.col("cohort").isNotNull())

    def was_active(offset: Column) -> Column:
        at = F.col("cohort") + offset
        word = F.element_at(F.array(*words), F.floor(at / _WORD).cast("int") + 1)
        return F.call_function("shiftrightunsigned", word, at % _WORD).bitwiseAND(F.lit(1)) == 1

    offsets = F.filter(F.sequence(F.lit(0), F.lit(query.periods)), was_active)
    return (
        persons.select("cohort", F.explode(F.concat(F.array(F.lit(-1)), offsets)).alias("offset"))
        .groupBy("cohort", "offset")
        .agg(F.count(F.lit(1)).alias("users"))
        .withColumn("cohort", F.date_add(F.lit(origin.date()), F.col("cohort") * length))
    )


def retention_matrix(
    events: DataFrame,
    project_id: str,
    query: RetentionQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
) -> DataFrame:
    """``cohort, offset, users``: persons of the cohort active ``offset`` periods later."""
    return _cells(events, project_id, query, links, dedup).filter("offset >= 0")


def cohort_sizes(
    events: DataFrame,
    project_id: str,
    query: RetentionQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
) -> DataFrame:
    """``cohort, size``: persons by the period of their first start event in the range.

    Reads start events of the range only; what came after them does not matter here.
    """
    length = _DAYS[query.period]
    origin = _first_period(query)
    rows = current_rows(events, project_id, query.start, query.end, {query.start_event}, dedup)
    days = F.datediff(F.to_date("timestamp"), F.lit(origin.date()))
    rows = rows.withColumn("cohort", F.floor(days / length).cast("int"))
    first = first_links(link_rows(events) if links is None else links, project_id)
    persons = by_person(rows, first, [], {"cohort": F.min})
    sizes = persons.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("cohort", F.date_add(F.lit(origin.date()), F.col("cohort") * length))


def retention(
    events: DataFrame,
    project_id: str,
    query: RetentionQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
) -> DataFrame:
    """``cohort, size, offset, users, rate`` with every offset from 0 to ``periods``.

    A cohort row carries at most 53 counts, and there are at most 366 cohorts.
    """
    cells = _cells(events, project_id, query, links, dedup)
    cohorts = cells.groupBy("cohort").agg(
        F.map_from_entries(F.collect_list(F.struct("offset", "users"))).alias("counts")
    )
    dense = cohorts.select(
        "cohort",
        F.element_at("counts", F.lit(-1)).alias("size"),
        F.explode(F.sequence(F.lit(0), F.lit(query.periods))).alias("offset"),
        "counts",
    )
    users = F.coalesce(F.try_element_at("counts", F.col("offset")), F.lit(0))
    return dense.select("cohort", "size", "offset", users.alias("users")).withColumn(
        "rate", rate("users", "size")
    )
