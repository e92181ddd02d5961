"""Scalar expressions, as DataFrame columns.

Everything here is a built-in expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date(text: str) -> Column:
    """DATE('yyyy-mm-dd')."""
    return F.to_date(F.lit(text))


def case(*branches: tuple[Column, object], default: object = None) -> Column:
    """CASE WHEN ... THEN ... ELSE default END."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if out is None:
        return F.lit(default)
    return out.otherwise(default)


def true_only(condition: Column) -> Column:
    """A condition where null counts as false, so that its negation keeps rows it doesn't decide."""
    return F.coalesce(condition, F.lit(False))


def epoch_seconds(timestamp: Column) -> Column:
    """Seconds since 1970-01-01 UTC of an ISO-8601 text or timestamp; one without a zone is of the session's."""
    return F.unix_timestamp(timestamp.cast("timestamp"))


def utc_epoch_seconds(timestamp: Column) -> Column:
    """The same for timestamps without a zone that are meant in UTC, whatever the session's zone."""
    return F.unix_timestamp(F.from_utc_timestamp(timestamp.cast("timestamp"), F.current_timezone()))
