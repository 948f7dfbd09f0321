"""Typed query requests. Every guard runs here, before a job is planned."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from footfall.plans import limits

INTERVAL_SECONDS = {"hour": 3_600, "day": 86_400, "week": 604_800}
ORDERING_OPERATORS = ("gt", "gte", "lt", "lte")
PRESENCE_OPERATORS = ("is_set", "is_not_set")
OPERATORS = ("eq", "neq", "contains", *ORDERING_OPERATORS, *PRESENCE_OPERATORS)


def _check_name(kind: str, name: str, longest: int) -> None:
    if not isinstance(name, str) or not 1 <= len(name) <= longest:
        raise ValueError(f"{kind} must be a string of 1 to {longest} characters")


def _check_between(name: str, value: int, low: int, high: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


@dataclass(frozen=True)
class PropertyFilter:
    property: str
    operator: str
    value: str | float | bool | None = None

    def __post_init__(self) -> None:
        _check_name("property", self.property, limits.MAX_PROPERTY_NAME)
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator '{self.operator}'")
        if self.operator in PRESENCE_OPERATORS:
            return
        if self.value is None:
            raise ValueError(f"operator '{self.operator}' needs a value")
        if not isinstance(self.value, str | int | float):
            raise ValueError("a filter value is a string, a number or a boolean")
        is_number = isinstance(self.value, int | float) and not isinstance(self.value, bool)
        if self.operator in ORDERING_OPERATORS and not is_number:
            raise ValueError(f"operator '{self.operator}' needs a number")
        if self.operator == "contains" and not isinstance(self.value, str):
            raise ValueError("operator 'contains' needs a string")


def _check_filters(filters: Sequence[PropertyFilter]) -> None:
    if len(filters) > limits.MAX_FILTERS:
        raise ValueError(f"at most {limits.MAX_FILTERS} filters")


@dataclass(frozen=True, kw_only=True)
class TimeRange:
    """Half-open ``[start, end)``; both ends need a time zone."""

    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        if self.start.tzinfo is None or self.end.tzinfo is None:
            raise ValueError("'start' and 'end' need a time zone")
        # Event times have millisecond precision, and so have the bounds.
        for field in ("start", "end"):
            value = getattr(self, field).astimezone(UTC)
            value = value.replace(microsecond=value.microsecond // 1000 * 1000)
            object.__setattr__(self, field, value)
        if self.end <= self.start:
            raise ValueError("'end' must be after 'start'")
        if self.end - self.start > timedelta(days=limits.MAX_RANGE_DAYS):
            raise ValueError(f"time range exceeds {limits.MAX_RANGE_DAYS} days")


def _check_buckets(query: TimeRange, interval: str) -> None:
    if interval not in INTERVAL_SECONDS:
        raise ValueError(f"unknown interval '{interval}'")
    count = (query.end - query.start).total_seconds() / INTERVAL_SECONDS[interval]
    if count > limits.MAX_BUCKETS:
        raise ValueError(
            f"{int(count)} {interval} buckets exceed the limit of {limits.MAX_BUCKETS}"
        )


@dataclass(frozen=True, kw_only=True)
class SegmentationQuery(TimeRange):
    event: str
    interval: str = "day"
    measure: str = "total"  # or "unique_users"
    breakdown: str | None = None
    filters: Sequence[PropertyFilter] = ()
    breakdown_limit: int = limits.BREAKDOWN_LIMIT

    def __post_init__(self) -> None:
        super().__post_init__()
        _check_name("event", self.event, limits.MAX_EVENT_NAME)
        if self.measure not in ("total", "unique_users"):
            raise ValueError(f"unknown measure '{self.measure}'")
        if self.breakdown is not None:
            _check_name("breakdown", self.breakdown, limits.MAX_PROPERTY_NAME)
        _check_filters(self.filters)
        _check_buckets(self, self.interval)
        _check_between("breakdown_limit", self.breakdown_limit, 1, 1_000)


@dataclass(frozen=True)
class FunnelStep:
    event: str
    filters: Sequence[PropertyFilter] = ()

    def __post_init__(self) -> None:
        _check_name("event", self.event, limits.MAX_EVENT_NAME)
        _check_filters(self.filters)


@dataclass(frozen=True, kw_only=True)
class FunnelQuery(TimeRange):
    steps: Sequence[FunnelStep]
    window_seconds: int = 7 * 86_400

    def __post_init__(self) -> None:
        super().__post_init__()
        if not limits.MIN_FUNNEL_STEPS <= len(self.steps) <= limits.MAX_FUNNEL_STEPS:
            raise ValueError(
                f"a funnel has {limits.MIN_FUNNEL_STEPS} to {limits.MAX_FUNNEL_STEPS} steps"
            )
        _check_between("window_seconds", self.window_seconds, 1, limits.MAX_FUNNEL_WINDOW_SECONDS)


@dataclass(frozen=True, kw_only=True)
class RetentionQuery(TimeRange):
    start_event: str
    return_event: str | None = None  # None: any event counts as coming back
    period: str = "week"  # or "day"
    periods: int = 8

    def __post_init__(self) -> None:
        super().__post_init__()
        _check_name("start_event", self.start_event, limits.MAX_EVENT_NAME)
        if self.return_event is not None:
            _check_name("return_event", self.return_event, limits.MAX_EVENT_NAME)
        if self.period not in ("day", "week"):
            raise ValueError(f"unknown period '{self.period}'")
        _check_between("periods", self.periods, 1, limits.MAX_PERIODS)


@dataclass(frozen=True, kw_only=True)
class SessionsQuery(TimeRange):
    interval: str = "day"
    inactivity_minutes: int = 30

    def __post_init__(self) -> None:
        super().__post_init__()
        _check_buckets(self, self.interval)
        _check_between("inactivity_minutes", self.inactivity_minutes, 1, limits.MAX_INACTIVITY_MINUTES)


@dataclass(frozen=True, kw_only=True)
class ListingQuery:
    """The last ``days`` days before ``as_of`` (and 5 minutes past it, for clocks ahead).

    ``limit`` asks for the most frequent entries alone; without it all are listed.
    """

    as_of: datetime
    days: int = 30
    limit: int | None = None

    def __post_init__(self) -> None:
        if self.as_of.tzinfo is None:
            raise ValueError("'as_of' needs a time zone")
        _check_between("days", self.days, 1, limits.MAX_LISTING_DAYS)
        if self.limit is not None and self.limit < 1:
            raise ValueError("'limit' must be at least 1")

    @property
    def start(self) -> datetime:
        return self.as_of - timedelta(days=self.days)

    @property
    def end(self) -> datetime:
        return self.as_of + timedelta(minutes=5)
