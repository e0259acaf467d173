"""Unit conversions used by the statistics (plain arithmetic columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_to_minutes(c) -> Column:
    return _c(c) / F.lit(60.0)


def seconds_to_hours(c) -> Column:
    return _c(c) / F.lit(3600.0)


def seconds_to_ms(c) -> Column:
    return _c(c) * F.lit(1000.0)


def bytes_to_mb(c) -> Column:
    return _c(c) / F.lit(1024.0 * 1024.0)


def percent(used, total) -> Column:
    """``used / total * 100``; null when the total is zero."""
    return F.try_divide(_c(used).cast("double"), _c(total).cast("double")) * F.lit(100.0)
