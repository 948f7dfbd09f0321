"""Typed access to JSON properties, and the property filters.

Property names are data: they become field names of a schema object, never query text.
``from_json`` with just the wanted fields skips every other key while it parses, keeps the
JSON type of each value (VARIANT), and tells an absent key (NULL) from a JSON null (VOID).
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.plans.requests import PropertyFilter

_ORDERING = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


class Properties:
    """Columns for a set of named properties of one JSON object column."""

    def __init__(self, names: Iterable[str], source: str = "properties") -> None:
        self.names = list(dict.fromkeys(names))
        self.source = source

    def parsed(self, kind: T.DataType | None = None) -> Column:
        """One struct, a VARIANT (or another type) per property; fields are renamed by position."""
        kind = kind or T.VariantType()
        wanted = T.StructType([T.StructField(name, kind) for name in self.names])
        numbered = T.StructType([T.StructField(f"p{i}", kind) for i in range(len(self.names))])
        # The corrupt-record field must not carry the name of a property.
        spare = "_" + max(self.names, key=len, default="")
        return F.from_json(
            self.source, wanted, {"columnNameOfCorruptRecord": spare, "allowSingleQuotes": "false"}
        ).cast(numbered)

    def value(self, name: str) -> Column:
        return self.parsed().getField(f"p{self.names.index(name)}")

    def display(self, name: str) -> Column:
        """The value as text: strings unquoted, everything else as its JSON text, '' when absent."""
        only = Properties([name], self.source)
        text = only.parsed(T.StringType()).getField("p0")
        # Text does not tell a JSON null from an absent key; looked at only where it matters.
        return F.coalesce(text, F.when(only.value(name).isNotNull(), "null"), F.lit(""))


# JSON type by the first two letters of the SQL type a VARIANT reports.
_JSON_TYPES = {
    "ST": "string",
    "BI": "number",
    "DO": "number",
    "DE": "number",
    "FL": "number",
    "BO": "boolean",
    "OB": "object",
    "AR": "array",
    "VO": "null",
}


def json_type(value: Column) -> Column:
    """'string', 'number', 'boolean', 'object', 'array' or 'null'; NULL for an absent value."""
    names = F.create_map(*(F.lit(text) for pair in _JSON_TYPES.items() for text in pair))
    return F.try_element_at(names, F.substring(F.schema_of_variant(value), 1, 2))


def whole_rows(*columns: Column | str) -> Column:
    """Select these columns through a generator. A filter on them then runs on finished rows;
    without it Catalyst would move the filter below the projections that parse JSON and
    evaluate them again inside it."""
    return F.inline(F.array(F.struct(*columns)))


def typed(value: Column, kind: str) -> Column:
    """The value as ``kind``, NULL when its JSON type is another (no coercion)."""
    spark_type = {"string": "string", "number": "double", "boolean": "boolean"}[kind]
    return F.when(json_type(value) == kind, F.try_variant_get(value, "$", spark_type))


def display(value: Column) -> Column:
    """Strings unquoted, everything else as JSON text, '' when absent."""
    text = F.when(json_type(value) == "string", F.try_variant_get(value, "$", "string")).otherwise(
        F.to_json(value)
    )
    return F.coalesce(text, F.lit(""))


def _equals(value: Column, wanted: str | float | bool) -> Column:
    if isinstance(wanted, bool):
        return typed(value, "boolean") == F.lit(wanted)
    if isinstance(wanted, int | float):
        return typed(value, "number") == F.lit(float(wanted))
    return typed(value, "string") == F.lit(wanted)


def _matches(value: Column, f: PropertyFilter) -> Column:
    present = value.isNotNull()
    if f.operator == "is_set":
        return present
    if f.operator == "is_not_set":
        return ~present
    if f.operator == "eq":
        return F.coalesce(_equals(value, f.value), F.lit(False))
    if f.operator == "neq":
        # A value of another type differs; an absent one never matches.
        return present & ~F.coalesce(_equals(value, f.value), F.lit(False))
    if f.operator == "contains":
        found = F.contains(F.lower(typed(value, "string")), F.lower(F.lit(f.value)))
    else:
        found = _ORDERING[f.operator](typed(value, "number"), F.lit(float(f.value)))
    return F.coalesce(found, F.lit(False))


def matches_all(filters: Sequence[PropertyFilter], properties: Properties) -> Column:
    """AND of the filters; true without any."""
    return functools.reduce(
        operator.and_, (_matches(properties.value(f.property), f) for f in filters), F.lit(True)
    )
