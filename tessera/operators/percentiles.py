"""Exact percentiles of any number of values per group, without gathering a group in a task.

Equal values are counted first (combinable), the distinct values are sorted by ranges, every
range counts its own rows, and the two neighbours of each percentile's position are picked by
their running count and interpolated linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bounded import broadcast_if_small


def same_group(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def exact_percentiles(df: DataFrame, group_cols: list[str], value: Column, probs: list[float]) -> DataFrame:
    """``(group..., p0, p1, ...)``: null values don't count."""
    groups = [f"__g{i}" for i in range(len(group_cols))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    counted = (df.select(*[F.col(c).alias(g) for c, g in zip(group_cols, groups)], value.cast("double").alias("__x"))
               .where("__x is not null").groupBy(*groups, "__x").agg(F.count(F.lit(1)).alias("__c")))
    ranged = cut_lineage(counted.repartitionByRange(parts, *groups, "__x").withColumn("__b", F.spark_partition_id()))
    # one row per group and range
    sizes = ranged.groupBy(*groups, "__b").agg(F.sum("__c").alias("__s"))
    before = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"{g}_o") for g in groups], F.col("__b").alias("__bo"),
                           F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"),
                           F.sum("__s").over(Window.partitionBy(*groups)).alias("__n"))
    on = F.col("__b") == F.col("__bo")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}_o"))
    up_to = Window.partitionBy(*groups, "__b").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    placed = (ranged.join(broadcast_if_small(offsets, row_bytes=64), on).withColumn("__upto", F.sum("__c").over(up_to) + F.col("__off"))
              .withColumn("__from", F.col("__upto") - F.col("__c")))
    picks, out = [], []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("__n") - 1)
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__upto")), F.col("__x"))).alias(f"{name}{i}"))
        # (hi - at) and (at - lo) as Spark's own percentile weighs them
        out.append(F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise(
            (F.ceil(at) - at) * F.col(f"lo{i}") + (at - F.floor(at)) * F.col(f"hi{i}")).alias(f"p{i}"))
    return (placed.groupBy(*groups).agg(F.max("__n").alias("__n"), *picks)
            .select(*[F.col(g).alias(c) for g, c in zip(groups, group_cols)], *out))
