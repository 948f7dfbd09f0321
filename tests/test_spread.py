"""Work on texts made from small tables is spread: no task gets the whole of a table, or all items of an event."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from footfall.operators import ingest as ingest_module
from footfall.operators.ingest import ingest, validate, explode_batches
from footfall.sources import sample

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_by_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_log_messages_are_made_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(sample, "TASK_ROWS", 100)
    messages = sample.raw_messages(spark, SF)
    sizes = rows_by_task(messages)
    assert len(sizes) >= 8 and max(sizes) < 300
    assert sum(sizes) == messages.count() == 1020


def test_client_batches_are_spread_and_their_texts_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sample, "TASK_ROWS", 100)
    batches = sample.raw_batches(spark, SF)
    assert len(rows_by_task(batches)) >= 5
    assert executed(batches).count("Exchange hashpartitioning") == 1


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_items_of_a_frequent_event_meet_its_rules_in_many_tasks(spark, no_broadcast):
    items = ingest(sample.raw_batches(spark, SF), sample.tracking_plans(spark, SF)).items
    joins = [line for line in executed(items).splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 2 and all("_salt" in line for line in joins)


def test_a_filter_on_errors_does_not_validate_again(spark):
    valid = validate(explode_batches(sample.raw_batches(spark, SF))).filter(F.size("errors") == 0)
    assert optimized(valid.select("index", "event_id")).count("from_json(") == 1


def test_demo_users_are_spread(spark, monkeypatch):
    from footfall import catalog

    monkeypatch.setattr(sample, "TASK_ROWS", 20)
    sizes = rows_by_task(catalog._users(spark, SF))
    assert len(sizes) >= 4 and max(sizes) < 100 and sum(sizes) == 150


def test_rules_are_repeated_for_the_parts_of_busy_projects_alone(spark, monkeypatch):
    batches, plans = sample.raw_batches(spark, SF), sample.tracking_plans(spark, SF)
    projects = plans.select("project_id").distinct().count()
    single = ingest(batches, plans).items
    assert ingest_module.rules_by_part(plans, ingest_module.busy_projects(batches)).count() == projects
    monkeypatch.setattr(ingest_module, "PART_BATCHES", 10)
    busy = ingest_module.busy_projects(batches)
    parts = {r["project_id"][-1]: r["_parts"] for r in busy.collect()}
    assert len(parts) == 2 and min(parts.values()) > 1
    assert ingest_module.rules_by_part(plans, busy).count() == projects - 2 + sum(parts.values())
    compared = ["batch_id", "index", "outcome", "errors", "violations", "enforcement"]
    spread = ingest(batches, plans).items
    assert sorted(map(str, spread.select(compared).collect())) == sorted(map(str, single.select(compared).collect()))


def test_items_meet_the_rules_of_projects_that_send_alone(spark, monkeypatch):
    batches, plans = sample.raw_batches(spark, SF), sample.tracking_plans(spark, SF)
    met, check = [], ingest_module.check_plans

    def checked(items, plans, busy):
        met.append(plans)
        return check(items, plans, busy)

    monkeypatch.setattr(ingest_module, "check_plans", checked)
    found = ingest(batches, plans).items
    senders = {r[0] for r in batches.select("project_id").distinct().collect()}
    assert len(senders) == 2 and {r["project_id"] for r in met[0].select("project_id").collect()} == senders
    assert met[0].count() == 6 < plans.count()
    compared = ["batch_id", "index", "outcome", "errors", "violations", "enforcement"]
    monkeypatch.setattr(ingest_module, "plans_in_use", lambda plans, batches: plans)
    whole = ingest(batches, plans).items
    assert sorted(map(str, found.select(compared).collect())) == sorted(map(str, whole.select(compared).collect()))
