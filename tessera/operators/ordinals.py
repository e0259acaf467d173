"""Ordinals (O1, O2, O5).

``dense_id`` never sends all rows to one task: one range shuffle over the order columns (and a
hash of the whole row, which splits equal keys and fixes their order) sorts the rows; each
range counts its own rows and is shifted by the count of all earlier ranges (a table with one
row per range, broadcast).  The sorted ranges are frozen by one reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a row's hashable columns."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def dense_id(df: DataFrame, order_by: list[str] | str, name: str = "n", start: int = 0,
             buckets: int | None = None, bucket_prefix: int = 0) -> DataFrame:
    """O1: ``start, start+1, ...`` over ``order_by`` (dense, gap-free, layout-independent);
    rows with equal keys are numbered in the order of their hash.  The input is read twice (range bounds
    and shuffle) and copied once.

    ``bucket_prefix=k``: the first ``k`` order columns already cut the rows into bounded
    groups (e.g. file and split offset of a line: one group is at most one input split), so
    those groups are the ranges — no bounds, no range shuffle, no checkpoint."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    if bucket_prefix:
        return _dense_by_groups(df, order_by, bucket_prefix, name, start)
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    tied = df.withColumn("__tie", row_hash(df))
    ranged = cut_lineage(
        tied.repartitionByRange(buckets, *order_by, "__tie").sortWithinPartitions(*order_by, "__tie")
        .withColumn("__b", F.spark_partition_id())
        # within a partition the low 33 bits of this id count the rows in order
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("__tie"))
    counts = ranged.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select(
        "__b",
        F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("__off"))
    # offsets has one row per bucket: bounded by ``buckets``
    return (ranged.join(F.broadcast(offsets), "__b")
            .withColumn(name, (F.col("__row") + F.col("__off") + F.lit(start)).cast("bigint"))
            .drop("__b", "__row", "__off"))


def _dense_by_groups(df: DataFrame, order_by: list[str], prefix: int, name: str, start: int) -> DataFrame:
    from .bounded import broadcast_if_small
    keys, rest = order_by[:prefix], order_by[prefix:]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    # one row per group (per input split): the running count is over a small table
    w_all = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__c").over(w_all), F.lit(0)).alias("__off"))
    offsets = broadcast_if_small(offsets, row_bytes=160)
    w = Window.partitionBy(*keys).orderBy(*(rest or keys))
    return (df.join(offsets, keys)
            .withColumn(name, (F.row_number().over(w) - 1 + F.col("__off") + F.lit(start)).cast("bigint"))
            .drop("__off"))


def batch_no(pos, size: int) -> Column:
    """``floor(pos / size)``."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(p / F.lit(size)).cast("bigint")
