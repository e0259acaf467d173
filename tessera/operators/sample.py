"""Heads and exact-k sampling.

``sample_documents`` returns exactly ``min(k, N)`` rows, uniform without replacement and
reproducible: rows are ranked by ``md5(id:seed)`` (tie by id), so the result does not depend
on partitioning and equals the DuckDB formulation.  Up to ``HEAD_ROWS`` rows, a head or a sample is
one scan in which each task keeps its first rows.  Beyond that, a sample counts the rows per hash
prefix, keeps whole prefixes below the boundary with a filter and orders only the boundary
prefix, and a head numbers the rows distributedly: no task ever merges that many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import dense_id, row_hash

_PREFIX_DIGITS = 4  # 65,536 hash buckets
#: rows that a task may keep as the first of its rows
HEAD_ROWS = 10_000


def sample_key(id_col: str, seed: int):
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def load_head(df: DataFrame, n: int | None, order_by: list[str] | str) -> DataFrame:
    """The first ``n`` accepted rows in input order (``None`` = all)."""
    if n is None:
        return df
    if n <= HEAD_ROWS:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        return df.withColumn("__tie", row_hash(df)).orderBy(*keys, "__tie").limit(n).drop("__tie")
    return dense_id(df, order_by, name="__pos").filter(F.col("__pos") < n).drop("__pos")


def sample_documents(df: DataFrame, k: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly ``min(k, N)`` rows."""
    if k <= HEAD_ROWS:
        return df.withColumn("__h", sample_key(id_col, seed)).orderBy("__h", id_col).limit(k).drop("__h")
    h = df.withColumn("__h", sample_key(id_col, seed)).withColumn("__p", F.substring("__h", 1, _PREFIX_DIGITS))
    hist = h.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per prefix (bounded by 16**_PREFIX_DIGITS): the running count is cheap
    cum = hist.withColumn("__cum", F.sum("__c").over(w)).withColumn("__before", F.col("__cum") - F.col("__c"))
    boundary = cum.filter(F.col("__cum") >= k).orderBy("__p").limit(1).collect()
    if not boundary:
        return h.drop("__h", "__p")
    bp, before = boundary[0]["__p"], int(boundary[0]["__before"])
    full = h.filter(F.col("__p") < bp)
    edge = h.filter(F.col("__p") == bp).orderBy("__h", id_col).limit(k - before)
    return full.unionByName(edge).drop("__h", "__p")
