"""Small scalar expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column | str, whole: Column | str, digits: int = 4) -> Column:
    """``round(part / whole, digits)``, 0.0 when there is nothing to divide by."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    ratio = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    return F.coalesce(F.round(ratio, digits), F.lit(0.0))


def uniform(seed: Column, salt: str, size: int) -> Column:
    """A reproducible integer in [0, size) from a key and a salt (first 32 bits of an MD5)."""
    text = F.concat_ws(":", seed.cast("string"), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % size


def uuid_from(text: Column) -> Column:
    """A reproducible UUID-shaped id made from a text."""
    digest = F.md5(text)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(digest, at, size) for at, size in cuts))


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form of a UUID text (plain, hyphenated, braced or URN), else NULL."""
    bare = F.lower(F.regexp_replace(text, r"^(?:urn:uuid:|\{)?([0-9a-fA-F-]+)\}?$", "$1"))
    well_formed = text.rlike(
        r"^(?i:[0-9a-f]{32}|(?:urn:uuid:)?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
        r"|\{[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\})$"
    )
    hexed = F.regexp_replace(bare, "-", "")
    return F.when(text.rlike("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), text).when(
        well_formed,
        F.regexp_replace(hexed, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    )


# ISO 8601 date-time with an explicit zone.
ZONED_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[Tt _]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[+-]\d{2}:?\d{2})$"
ANY_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}(?:[Tt _]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:[Zz]|[+-]\d{2}:?\d{2})?$"


def zoned_timestamp(text: Column) -> Column:
    """Instant of an ISO date-time that names its zone, else NULL."""
    plain = F.translate(text, "tz_", "TZ ")
    # Spark wants the seconds, which ISO lets go.
    with_seconds = F.when(F.substring(plain, 17, 1) == ":", plain).otherwise(
        F.concat(F.substring(plain, 1, 16), F.lit(":00"), F.substring(plain, 17, 6))
    )
    return F.when(text.rlike(ZONED_TIMESTAMP), F.try_to_timestamp(with_seconds))


def iso(column: Column | str) -> Column:
    """UTC timestamp as ISO text with microseconds and offset."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def histogram_edge(value: Column, edges: tuple[float, ...]) -> Column:
    """Smallest edge the value does not exceed; infinity above the last one."""
    result = F.lit(float("inf"))
    for edge in reversed(edges):
        result = F.when(value <= F.lit(float(edge)), F.lit(float(edge))).otherwise(result)
    return result
