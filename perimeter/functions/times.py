"""UTC wall-clock arithmetic on timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def seconds_of(ts: str) -> Column:
    """Whole seconds since the epoch of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, {ts})")


def hours_of(ts: str) -> Column:
    return F.expr(f"timestampdiff(HOUR, {EPOCH}, {ts})")


def at_hour(hour: str) -> Column:
    """Timestamp of a number of hours since the epoch."""
    return F.expr(f"timestampadd(HOUR, cast({hour} as int), {EPOCH})")


def at_second(sec: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {sec}, {EPOCH})")
