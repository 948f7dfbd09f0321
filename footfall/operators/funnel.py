"""Where do people drop off: ordered steps within a window that starts at the first step.

Time runs in whole seconds. Events of one second count in step order, so the order of two
events within a second never blocks a conversion, and one event may satisfy two steps that
ask for the same thing.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from footfall.functions.props import Properties, matches_all
from footfall.functions.scalars import rate
from footfall.operators.identity import by_person, first_links, link_rows
from footfall.operators.scope import Dedup, current_rows
from footfall.plans.requests import FunnelQuery

DAY = 86_400


def funnel_levels(
    events: DataFrame,
    project_id: str,
    query: FunnelQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
    stretch: int | None = None,
) -> DataFrame:
    """``person_id, level``: the deepest step each person who entered has reached.

    Entering must happen before ``end``; later steps may follow up to the window after it.

    Each (person, second) becomes one row with a bit per step, combined before the shuffle, so
    the busiest person has at most as many rows as the range has seconds. Over these rows a
    chain of running maxima carries, per step, the latest funnel start that got there: a later
    start is never worse, because its window closes later.

    ``stretch`` is for projects where one person (a kiosk, a shared device) may have most of the seconds: the chain then
    runs over each (person, stretch of so many seconds) by itself and only summaries meet, so that person is spread over
    as many tasks as the range has stretches. A day (``DAY``) gives at most 86,400 rows to sort and 457 summaries a person. The
    result is the same for any length.
    """
    finish = query.end + timedelta(seconds=query.window_seconds)
    names = {step.event for step in query.steps}
    properties = Properties(f.property for step in query.steps for f in step.filters)
    mask = F.lit(0)
    for number, step in enumerate(query.steps):
        hit = (F.col("event") == step.event) & matches_all(step.filters, properties)
        if number == 0:
            hit = hit & (F.col("timestamp") < F.lit(query.end))
        mask = mask + F.when(hit, F.lit(1 << number)).otherwise(F.lit(0))
    carry = {"second": F.unix_seconds("timestamp"), "steps": mask}
    rows = current_rows(events, project_id, query.start, finish, names, dedup, carry)
    rows = rows.select(
        "project_id", "user_id", "anonymous_id", "distinct_id", "second", "steps"
    ).filter("steps > 0")

    first = first_links(link_rows(events) if links is None else links, project_id)
    moments = by_person(rows, first, ["second"], {"steps": F.bit_or})

    steps = len(query.steps)
    if stretch is None:
        last = _chain(moments, ["person_id"], query)
        reached = last.groupBy("person_id").agg(*(F.max(f"start_{k}").alias(f"start_{k}") for k in range(steps)))
    else:
        reached = _over_stretches(moments, query, stretch)
    level = sum(F.col(f"start_{k}").isNotNull().cast("int") for k in range(steps))
    return reached.select("person_id", level.alias("level")).filter("level > 0")


def _so_far(keys: list[str]) -> WindowSpec:
    by_second = Window.partitionBy(*keys).orderBy("second")
    return by_second.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _here(number: int) -> Column:
    return F.col("steps").bitwiseAND(F.lit(1 << number)) != 0


def _chain(moments: DataFrame, keys: list[str], query: FunnelQuery) -> DataFrame:
    """Adds ``start_<step>`` to the rows of each key: the latest entry, of those in the rows, that got to the step so far."""
    for number in range(len(query.steps)):
        if number == 0:
            start = F.when(_here(0), F.col("second"))
        else:
            before = F.col(f"start_{number - 1}")
            in_time = F.col("second") - before <= query.window_seconds
            start = F.when(_here(number) & in_time, before)
        moments = moments.withColumn(f"start_{number}", F.max(start).over(_so_far(keys)))
    return moments


def _over_stretches(moments: DataFrame, query: FunnelQuery, stretch: int) -> DataFrame:
    """``person_id, start_<step>…`` by way of summaries of stretches of so many seconds, each by a task of its own.

    What a stretch does to the latest entries that reach it is known from two things: the latest entries of its own that
    reach each step (``start_<step>``), and the earliest second by which it holds the steps after ``i`` up to ``j`` in
    order (``end_<i>_<j>``). An entry that had reached ``i`` reaches ``j`` in it when that second lies in its window:
    the last step of a chain is the one that decides. A person's summaries, one for each stretch of the range with
    hits, are then put together in order of time.
    """
    steps = len(query.steps)
    keys = ["person_id", "stretch"]
    rows = _chain(moments.withColumn("stretch", F.floor(F.col("second") / stretch)), keys, query)
    pairs = [(i, j) for i in range(steps - 1) for j in range(i + 1, steps)]
    for i, j in pairs:
        held = _here(j) if j == i + 1 else _here(j) & F.col(f"end_{i}_{j - 1}").isNotNull()
        rows = rows.withColumn(f"end_{i}_{j}", F.min(F.when(held, F.col("second"))).over(_so_far(keys)))
    summaries = rows.groupBy(*keys).agg(
        *(F.max(f"start_{k}").alias(f"start_{k}") for k in range(steps)),
        *(F.min(f"end_{i}_{j}").alias(f"end_{i}_{j}") for i, j in pairs),
    )
    in_order = F.sort_array(F.collect_list(F.struct("stretch", *summaries.columns[2:])))

    def after(state: Column, summary: Column) -> Column:
        def latest(j: int) -> Column:
            carried = [
                F.when(summary[f"end_{i}_{j}"] - state[f"start_{i}"] <= query.window_seconds, state[f"start_{i}"])
                for i in range(j)
            ]
            return F.greatest(state[f"start_{j}"], summary[f"start_{j}"], *carried).alias(f"start_{j}")

        return F.struct(*(latest(j) for j in range(steps)))

    nothing = F.struct(*(F.lit(None).cast("bigint").alias(f"start_{k}") for k in range(steps)))
    folded = summaries.groupBy("person_id").agg(in_order.alias("summaries"))
    return folded.select("person_id", F.aggregate("summaries", nothing, after).alias("state")).select(
        "person_id", "state.*"
    )


def funnel_report(levels: DataFrame, query: FunnelQuery) -> DataFrame:
    """``step, event, users, conversion_from_start, conversion_from_previous``."""
    counts = [
        F.count_if(F.col("level") >= number).alias(f"users_{number}")
        for number in range(1, len(query.steps) + 1)
    ]
    steps = []
    for number, step in enumerate(query.steps, start=1):
        users = F.col(f"users_{number}")
        steps.append(
            F.struct(
                F.lit(number).alias("step"),
                F.lit(step.event).alias("event"),
                users.alias("users"),
                rate(users, F.col("users_1")).alias("conversion_from_start"),
                rate(users, F.col(f"users_{max(number - 1, 1)}")).alias("conversion_from_previous"),
            )
        )
    return levels.agg(*counts).select(F.inline(F.array(*steps)))


def funnel(
    events: DataFrame,
    project_id: str,
    query: FunnelQuery,
    links: DataFrame | None = None,
    dedup: Dedup = True,
    stretch: int | None = None,
) -> DataFrame:
    return funnel_report(funnel_levels(events, project_id, query, links, dedup, stretch), query)
