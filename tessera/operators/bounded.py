"""Size-checked broadcast helpers.

A side is broadcast only after its size was measured against a bound; callers that can
exceed the bound split the work (query blocks) or fall back to a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# default ceiling for anything we ship to every task
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, row_bytes: int, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``rows * row_bytes`` stays under the bound (one count job)."""
    return df.count() * max(row_bytes, 1) <= max_bytes


def broadcast_if_small(df: DataFrame, row_bytes: int, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only behind a measured size; otherwise let the planner shuffle."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, max_bytes) else df


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deals the rows out over ``partitions`` tasks in front of a CPU-heavy stage; None (the
    default of every operator) keeps the input's own splits."""
    return df.repartition(partitions) if partitions else df
