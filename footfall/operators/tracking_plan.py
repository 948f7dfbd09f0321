"""Tracking plans: versions per project, violations of one event, breaking changes of a version.

A plan is bounded (at most 1,000 events), so it is compared inside its row with array
expressions; projects spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.props import json_type
from footfall.plans import limits
from footfall.schemas import PLAN

PROPERTY_TYPES = ("string", "number", "boolean", "object", "array")


def parse_plans(rows: DataFrame) -> DataFrame:
    """``project_id, version, plan`` from a JSON text column ``plan``, with defaults filled in."""

    def property_spec(_: Column, spec: Column) -> Column:
        return F.struct(
            spec.getField("type").alias("type"),
            F.coalesce(spec.getField("required"), F.lit(False)).alias("required"),
            spec.getField("enum").alias("enum"),
        )

    def event_spec(_: Column, spec: Column) -> Column:
        properties = F.coalesce(spec.getField("properties"), F.create_map().cast(_PROPERTIES))
        return F.struct(
            F.coalesce(spec.getField("additional_properties"), F.lit(True)).alias(
                "additional_properties"
            ),
            F.transform_values(properties, property_spec).alias("properties"),
        )

    given = F.from_json("plan", PLAN)
    events = F.coalesce(given.getField("events"), F.create_map().cast(PLAN["events"].dataType))
    plan = F.struct(
        F.coalesce(given.getField("enforcement"), F.lit("warn")).alias("enforcement"),
        F.coalesce(given.getField("allow_unplanned_events"), F.lit(True)).alias(
            "allow_unplanned_events"
        ),
        F.transform_values(events, event_spec).alias("events"),
    )
    return rows.withColumn("plan", plan)


_PROPERTIES = PLAN["events"].dataType.valueType["properties"].dataType


def plan_problem(plan: Column) -> Column:
    """Why a plan is not acceptable, or NULL."""
    events = F.map_entries(plan.getField("events"))
    properties = F.flatten(
        F.transform(events, lambda e: F.map_entries(e.getField("value").getField("properties")))
    )

    def bad_name(entry: Column) -> Column:
        return ~F.length(entry.getField("key")).between(1, limits.MAX_PROPERTY_NAME)

    return (
        F.when(~plan.getField("enforcement").isin("warn", "block"), "enforcement")
        .when(F.size(events) > limits.MAX_PLAN_EVENTS, "too_many_events")
        .when(F.exists(events, bad_name) | F.exists(properties, bad_name), "name_length")
        .when(
            F.exists(
                properties,
                lambda p: F.coalesce(
                    ~p.getField("value").getField("type").isin(*PROPERTY_TYPES), F.lit(True)
                ),
            ),
            "property_type",
        )
    )


def latest_plans(plans: DataFrame) -> DataFrame:
    """The active plan of each project: its highest version."""
    newest = F.max_by(F.struct("version", "plan"), "version")
    return plans.groupBy("project_id").agg(newest.alias("newest")).select("project_id", "newest.*")


def flatten_plans(plans: DataFrame) -> DataFrame:
    """One row per planned property; an event without properties has one row with NULLs."""
    per_event = plans.select(
        "project_id",
        "version",
        F.col("plan.enforcement").alias("enforcement"),
        F.col("plan.allow_unplanned_events").alias("allow_unplanned_events"),
        F.explode("plan.events").alias("event", "spec"),
    )
    return per_event.select(
        "project_id",
        "version",
        "enforcement",
        "allow_unplanned_events",
        "event",
        F.col("spec.additional_properties").alias("additional_properties"),
        F.explode_outer("spec.properties").alias("property", "rule"),
    ).select(
        "project_id",
        "version",
        "enforcement",
        "allow_unplanned_events",
        "event",
        "additional_properties",
        "property",
        F.col("rule.type").alias("type"),
        F.col("rule.required").alias("required"),
        F.transform("rule.enum", _label).alias("enum"),
    )


def _comparable(value: Column) -> Column:
    """A text that is equal for equal values: numbers (and booleans) by value, strings exactly."""
    kind = json_type(value)
    return (
        F.when(kind == "string", F.concat(F.lit("s"), F.try_variant_get(value, "$", "string")))
        .when(
            kind == "number",
            F.concat(F.lit("n"), F.try_variant_get(value, "$", "double").cast("string")),
        )
        .when(
            kind == "boolean",
            F.when(F.try_variant_get(value, "$", "boolean"), "n1.0").otherwise("n0.0"),
        )
        .otherwise(F.lit("other"))
    )


def _label(value: Column) -> Column:
    """An allowed value as text: strings as they are, numbers with a decimal point."""
    return F.substring(_comparable(value), 2, 2_147_483_647)


def planned_events(plans: DataFrame, *kept: str) -> DataFrame:
    """``project_id, event, spec``: the rules of each planned event, and the columns to be kept."""
    return plans.select("project_id", *kept, F.explode("plan.events").alias("event", "spec"))


def event_violations(event: Column, properties: Column, plan: Column) -> Column:
    """Violations of one event in plan order; ``properties`` is MAP<STRING, VARIANT>."""
    spec = F.try_element_at(plan.getField("events"), event)
    return spec_violations(properties, spec, plan.getField("allow_unplanned_events"))


def spec_violations(properties: Column, spec: Column, allow_unplanned: Column) -> Column:
    """Violations against the rules of an event; ``spec`` is NULL for an event without rules,
    ``allow_unplanned`` for a project without a plan."""
    rules = spec.getField("properties")

    def problem(entry: Column) -> Column:
        name, rule = entry.getField("key"), entry.getField("value")
        value = F.try_element_at(properties, name)
        allowed = F.transform(rule.getField("enum"), _comparable)
        return (
            F.when(
                ~F.map_contains_key(properties, name),
                F.when(rule.getField("required"), F.concat(F.lit("missing_required:"), name)),
            )
            .when(
                ~json_type(value).eqNullSafe(rule.getField("type")),
                F.concat(F.lit("wrong_type:"), name, F.lit(":expected_"), rule.getField("type")),
            )
            .when(
                allowed.isNotNull() & ~F.array_contains(allowed, _comparable(value)),
                F.concat(F.lit("value_not_allowed:"), name),
            )
        )

    listed = F.filter(F.transform(F.map_entries(rules), problem), lambda p: p.isNotNull())
    surplus = F.transform(
        F.filter(F.map_keys(properties), lambda k: ~F.map_contains_key(rules, k)),
        lambda k: F.concat(F.lit("unexpected_property:"), k),
    )
    none = F.array().cast("array<string>")
    unplanned = F.when(allow_unplanned, none).otherwise(F.array(F.lit("unplanned_event")))
    return (
        F.when(allow_unplanned.isNull(), none)
        .when(spec.isNull(), unplanned)
        .when(spec.getField("additional_properties"), listed)
        .otherwise(F.concat(listed, surplus))
    )


def _quoted(text: Column) -> Column:
    """A string in quotes, double ones where it holds a single quote and no double quote."""
    slashed = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    plain = F.concat(F.lit("'"), slashed, F.lit("'"))
    return (
        F.when(~F.contains(text, F.lit("'")), plain)
        .when(~F.contains(text, F.lit('"')), F.concat(F.lit('"'), slashed, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(slashed, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def _property_changes(where: Column, old: Column, new: Column) -> Column:
    """Changes of one property; ``old`` is NULL when the property is new."""

    def change(happens: Column, *text: Column | str) -> Column:
        parts = [F.lit(part) if isinstance(part, str) else part for part in text]
        return F.when(happens, F.concat(where, *parts))

    old_enum = F.transform(old.getField("enum"), _comparable)
    new_enum = F.transform(new.getField("enum"), _comparable)
    removed = F.array_sort(
        F.transform(
            F.array_except(old_enum, new_enum), lambda v: F.substring(v, 2, 2_147_483_647)
        )
    )
    removed_text = F.concat(
        F.lit("["), F.array_join(F.transform(removed, _quoted), ", "), F.lit("]")
    )
    known = F.array(
        change(
            old.getField("type") != new.getField("type"),
            ":type_changed:",
            old.getField("type"),
            "->",
            new.getField("type"),
        ),
        change(new.getField("required") & ~old.getField("required"), ":now_required"),
        change(new_enum.isNotNull() & old_enum.isNull(), ":enum_added"),
        change(F.size(removed) > 0, ":enum_values_removed:", removed_text),
    )
    added = F.array(change(new.getField("required"), ":new_required_property"))
    return F.when(old.isNull(), added).otherwise(known)


def plan_changes(old: Column, new: Column) -> Column:
    """Breaking changes from one plan to the next: what lets an event pass the old plan and
    fail the new one. Array of texts, empty when there are none."""
    now_closed = ~new.getField("allow_unplanned_events")
    general = F.array(
        F.when(
            (old.getField("enforcement") == "warn") & (new.getField("enforcement") == "block"),
            "enforcement:warn->block (violating events will now be dropped)",
        ),
        F.when(
            old.getField("allow_unplanned_events") & now_closed, "unplanned_events:now_disallowed"
        ),
    )

    def of_event(entry: Column) -> Column:
        name, before = entry.getField("key"), entry.getField("value")
        after = F.try_element_at(new.getField("events"), name)
        closed = before.getField("additional_properties") & ~after.getField("additional_properties")
        of_properties = F.flatten(
            F.transform(
                F.map_entries(after.getField("properties")),
                lambda p: _property_changes(
                    F.concat(name, F.lit("."), p.getField("key")),
                    F.try_element_at(before.getField("properties"), p.getField("key")),
                    p.getField("value"),
                ),
            )
        )
        return F.when(
            after.isNull(), F.array(F.when(now_closed, F.concat(name, F.lit(":removed"))))
        ).otherwise(
            F.concat(
                F.array(F.when(closed, F.concat(name, F.lit(":additional_properties_disallowed")))),
                of_properties,
            )
        )

    of_events = F.flatten(F.transform(F.map_entries(old.getField("events")), of_event))
    return F.filter(F.concat(general, of_events), lambda change: change.isNotNull())


def breaking_changes(plans: DataFrame) -> DataFrame:
    """``project_id, from_version, to_version, position, change`` over consecutive versions."""
    older = plans.select(
        "project_id",
        (F.col("version") + 1).alias("version"),
        F.col("version").alias("from_version"),
        F.col("plan").alias("old"),
    )
    pairs = plans.join(older, ["project_id", "version"])
    return pairs.select(
        "project_id",
        "from_version",
        F.col("version").alias("to_version"),
        F.posexplode(plan_changes(F.col("old"), F.col("plan"))).alias("position", "change"),
    )


def next_versions(plans: DataFrame, proposed: DataFrame) -> DataFrame:
    """Decide on proposed plans (``project_id, plan, allow_breaking``), one per project.

    Returns them with ``version`` (next after the project's highest), ``changes`` and ``status``:
    ``saved``, ``breaking_change``, ``invalid:<reason>``, or ``conflicting_proposals`` where a
    project has several at once. ``append_versions`` stores the saved ones.
    """
    current = latest_plans(plans).select(
        "project_id", F.col("version").alias("current"), F.col("plan").alias("old")
    )
    counted = proposed.groupBy("project_id").agg(F.count(F.lit(1)).alias("proposals"))
    judged = proposed.join(counted, "project_id").join(current, "project_id", "left")
    none = F.array().cast("array<string>")
    changes = F.when(F.col("old").isNull(), none).otherwise(plan_changes(F.col("old"), F.col("plan")))
    problem = plan_problem(F.col("plan"))
    status = (
        F.when(problem.isNotNull(), F.concat(F.lit("invalid:"), problem))
        .when(F.col("proposals") > 1, "conflicting_proposals")
        .when((F.size("changes") > 0) & ~F.col("allow_breaking"), "breaking_change")
        .otherwise("saved")
    )
    return (
        judged.withColumn("changes", changes)
        .withColumn("status", status)
        .withColumn("version", F.coalesce("current", F.lit(0)) + 1)
        .select("project_id", "version", "plan", "changes", "status")
    )


def append_versions(decided: DataFrame, path: str) -> None:
    """Append the saved rows of ``next_versions`` to the stored plan table at ``path``.

    One writer at a time is assumed: the decision reads the table it appends to.
    """
    saved = decided.filter(F.col("status") == "saved")
    saved.select("project_id", "version", "plan").write.mode("append").parquet(path)
