"""Stored events for the tests."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime, timedelta

MONDAY = datetime(2026, 6, 1, tzinfo=UTC)
PROJECT = "00000000-0000-4000-8000-0000000000aa"


def at(days: float = 0, hours: float = 0) -> datetime:
    return MONDAY + timedelta(days=days, hours=hours)


def row(event, user, when, properties=None, anonymous_id=None, project=PROJECT, **extra) -> dict:
    """One stored event; other columns through ``extra``."""
    return {
        "project_id": project,
        "event_id": str(uuid.uuid4()),
        "event": event,
        "distinct_id": user or anonymous_id or "",
        "user_id": user,
        "anonymous_id": anonymous_id,
        "timestamp": when,
        "client_timestamp": None,
        "received_at": when,
        "properties": json.dumps(properties or {}),
        "context": "{}",
        "ip": None,
        "kafka_partition": 0,
        "kafka_offset": 0,
        "ingested_at": when,
        "violations": [],
    } | extra
