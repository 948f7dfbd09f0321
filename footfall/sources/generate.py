"""Reproducible demo data. Every value is a hash of the user number and a salt.

The functions take a DataFrame with a user number ``n`` (``spark.range(users)`` renamed, or a
column of any table), so the data grows with it and no step leaves its task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.scalars import uniform, uuid_from
from footfall.schemas import EVENTS

# Fixed values of the demo data set.
SIGNUP_SPREAD_SECONDS = 56 * 86_400
PLANS = ("free", "free", "pro", "team")
PATHS = ("/", "/pricing", "/docs", "/blog")
MAX_VIEWS = 20
CHECKOUT_PERCENT = 40
PURCHASE_PERCENT = 55
RETURN_WEEKS = 8
WEEK_SECONDS = 604_800

# Fixed values of the load-test batches.
BATCH_NAMES = ("page_viewed", "page_viewed", "page_viewed", "button_clicked", "signup", "purchase")
BATCH_PATHS = ("/", "/pricing", "/docs", "/blog", "/app")
BATCH_USERS = 1_000


def numbered_users(spark: SparkSession, users: int) -> DataFrame:
    return spark.range(users).withColumnRenamed("id", "n")


def _plus_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + seconds * 1_000_000)


def _pick(choices: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in choices)), number.cast("int") + 1)


def _signup_time(start: datetime) -> Column:
    return _plus_seconds(F.lit(start), uniform(F.col("n"), "signup", SIGNUP_SPREAD_SECONDS))


def _as_events(rows: DataFrame, project_id: str) -> DataFrame:
    """Fill the stored schema from ``n, event, nth, timestamp, received_at, properties``."""
    user = F.concat(F.lit("user-"), F.col("n").cast("string"))
    identity = F.concat_ws(":", F.lit(project_id), "event", F.col("n").cast("string"), "nth")
    given = {
        "project_id": F.lit(project_id),
        "event_id": uuid_from(identity),
        "event": F.col("event"),
        "distinct_id": user,
        "user_id": user,
        "timestamp": F.col("timestamp"),
        "received_at": F.col("received_at"),
        "properties": F.col("properties"),
        "context": F.lit("{}"),
        "kafka_partition": F.lit(0),
        "kafka_offset": F.lit(0).cast("bigint"),
        "ingested_at": F.col("received_at"),
        "violations": F.array().cast("array<string>"),
    }
    return rows.select(
        *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS.fields)
    )


def signups(users: DataFrame, project_id: str, start: datetime) -> DataFrame:
    """One signup per user, spread over eight weeks, with a plan."""
    plan = _pick(PLANS, uniform(F.col("n"), "plan", len(PLANS)))
    rows = users.select(
        "n",
        F.lit("signup").alias("event"),
        F.lit("0").alias("nth"),
        _signup_time(start).alias("timestamp"),
        _signup_time(start).alias("received_at"),
        F.concat(F.lit('{"plan":"'), plan, F.lit('"}')).alias("properties"),
    )
    return _as_events(rows, project_id)


def page_views(users: DataFrame, project_id: str, start: datetime) -> DataFrame:
    """0 to 19 views per user in the two days after signup."""
    views = uniform(F.col("n"), "views", MAX_VIEWS).cast("int")
    nth = F.when(views > 0, F.sequence(F.lit(0), views - 1)).otherwise(F.array().cast("array<int>"))
    each = users.withColumn("signup", _signup_time(start)).withColumn("i", F.explode(nth))
    seed = F.concat_ws(":", F.col("n").cast("string"), F.col("i").cast("string"))
    path = _pick(PATHS, uniform(seed, "path", len(PATHS)))
    rows = each.select(
        "n",
        F.lit("page_viewed").alias("event"),
        F.concat(F.lit("view-"), F.col("i").cast("string")).alias("nth"),
        _plus_seconds(F.col("signup"), uniform(seed, "pv", 172_800)).alias("timestamp"),
        F.col("signup").alias("received_at"),
        F.concat(F.lit('{"path":"'), path, F.lit('"}')).alias("properties"),
    )
    return _as_events(rows, project_id)


def funnel_steps(users: DataFrame, project_id: str, start: datetime) -> DataFrame:
    """40 % start a checkout within a day of signup; 55 % of those purchase hours later."""
    n = F.col("n")
    checks_out = uniform(n, "p_co", 100) < CHECKOUT_PERCENT
    purchases = checks_out & (uniform(n, "p_pu", 100) < PURCHASE_PERCENT)
    value = (uniform(n, "val", 491) + 9).cast("string")

    def step(event: str, after: Column, properties: Column, happens: Column) -> Column:
        return F.struct(
            F.lit(event).alias("event"),
            after.alias("after"),
            properties.alias("properties"),
            happens.alias("happens"),
        )

    steps = F.array(
        step("checkout_started", uniform(n, "co", 82_800) + 3_600, F.lit("{}"), checks_out),
        step(
            "purchase",
            uniform(n, "pu", 14_400) + 90_000,
            F.concat(F.lit('{"value":'), value, F.lit("}")),
            purchases,
        ),
    )
    each = users.select("n", _signup_time(start).alias("signup"), F.inline(steps)).filter("happens")
    moment = _plus_seconds(F.col("signup"), F.col("after"))
    rows = each.select(
        "n",
        "event",
        F.lit("0").alias("nth"),
        moment.alias("timestamp"),
        moment.alias("received_at"),
        "properties",
    )
    return _as_events(rows, project_id)


def return_visits(users: DataFrame, project_id: str, start: datetime) -> DataFrame:
    """Visits in weeks 1 to 8 after signup, less likely each week."""
    each = users.withColumn("signup", _signup_time(start)).withColumn(
        "week", F.explode(F.sequence(F.lit(1), F.lit(RETURN_WEEKS)))
    )
    seed = F.concat_ws(":", F.col("n").cast("string"), F.col("week").cast("string"))
    each = each.filter(uniform(seed, "ret", 100) < F.lit(45) - F.col("week") * 5)
    later = F.col("week") * WEEK_SECONDS + uniform(seed, "visit", WEEK_SECONDS)
    moment = _plus_seconds(F.col("signup"), later)
    rows = each.select(
        "n",
        F.lit("page_viewed").alias("event"),
        F.concat(F.lit("week-"), F.col("week").cast("string")).alias("nth"),
        moment.alias("timestamp"),
        moment.alias("received_at"),
        F.lit('{"path":"/app"}').alias("properties"),
    )
    return _as_events(rows, project_id)


def demo_events(users: DataFrame, project_id: str, start: datetime) -> DataFrame:
    """The whole demo data set."""
    parts = (signups, page_views, funnel_steps, return_visits)
    made = [part(users, project_id, start) for part in parts]
    events = made[0]
    for other in made[1:]:
        events = events.unionByName(other)
    return events


def load_batches(
    numbers: DataFrame, project_id: str, sent_at: datetime, batch_size: int = 100
) -> DataFrame:
    """Client batches of the load test: consecutive numbers ``n`` share a batch.

    A batch gathers at most ``batch_size`` items, provided the numbers are unique.
    """
    n = F.col("n")
    at = F.date_format(F.lit(sent_at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    place = n % batch_size
    user = F.concat(F.lit("user-"), uniform(n, "user", BATCH_USERS).cast("string"))
    item = F.to_json(
        F.struct(
            uuid_from(F.concat_ws(":", F.lit(project_id), F.lit("load"), n.cast("string"))).alias(
                "event_id"
            ),
            _pick(BATCH_NAMES, uniform(n, "name", len(BATCH_NAMES))).alias("event"),
            user.alias("user_id"),
            at.alias("timestamp"),
            F.struct(
                _pick(BATCH_PATHS, place % len(BATCH_PATHS)).alias("path"), place.alias("value")
            ).alias("properties"),
        )
    )
    batch = F.concat(F.lit("load-"), F.floor(n / batch_size).cast("string"))
    items = numbers.select(batch.alias("batch_id"), place.alias("place"), item.alias("item"))
    gathered = items.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "item"))).alias("items")
    )
    return gathered.select(
        "batch_id",
        F.lit(project_id).alias("project_id"),
        F.lit(sent_at).alias("received_at"),
        F.lit(None).cast("string").alias("ip"),
        F.lit(sent_at).alias("sent_at"),
        F.col("items.item").alias("batch"),
    )
