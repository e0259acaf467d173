"""Corpus expansion.

``f = ceil(target / n)``; copies ``0 .. f-2`` are whole (each row fans out with
``explode(sequence)`` — no join, no pair table); the last copy keeps only the first
``target - n*(f-1)`` rows in input order, taken by a distributed dense ordinal, so the result
has exactly ``target`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import fuzzy_prefix
from ..session import cut_lineage
from .sample import load_head


def _copy(df: DataFrame, rep: Column, strategy: str, id_col: str, text_col: str) -> DataFrame:
    tag = "_repeat_" if strategy == "repeat" else "_fuzzy_"
    out = df.withColumn("repeat_id", rep.cast("int"))
    out = out.withColumn(id_col, F.concat(F.col(id_col), F.lit(tag), F.col("repeat_id").cast("string")))
    if strategy != "repeat":
        out = out.withColumn(text_col, fuzzy_prefix(text_col, "repeat_id"))
    return out


def expand_documents(df: DataFrame, target_count: int, order_by: list[str] | str,
                     strategy: str = "repeat", id_col: str = "id", text_col: str = "text",
                     materialize: bool = True, parallelism: int | None = None) -> DataFrame:
    """Exactly ``target_count`` rows, or the input with a null ``repeat_id`` when it already
    has that many: the schema never depends on the size.  The input is read by the count, the
    whole copies and the last copy; ``materialize`` checkpoints it once first (pass False when it
    is a plain scan or already materialised).  ``parallelism`` deals the copies out over that
    many partitions (default: ``spark.sql.shuffle.partitions``)."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    if materialize:
        df = cut_lineage(df)
    n = df.count()
    if n >= target_count or n == 0:
        return df.withColumn("repeat_id", F.lit(None).cast("int"))
    f = math.ceil(target_count / n)
    last = target_count - n * (f - 1)
    parallelism = parallelism or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = []
    if f > 1:
        copies = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(f - 2)))).repartition(parallelism)
        parts.append(_copy(copies, F.col("__r"), strategy, id_col, text_col).drop("__r"))
    head = df if last >= n else load_head(df, last, order_by)
    parts.append(_copy(head, F.lit(f - 1), strategy, id_col, text_col))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hash_unit(h: Column, offset: int) -> Column:
    """A uniform value in (0, 1) from 8 hex digits of an md5 value."""
    return (F.conv(F.substring(h, offset, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def repeat_with_noise(vectors: DataFrame, target_count: int, order_by: list[str] | str,
                      sigma: float = 0.01, seed: int = 42, id_col: str = "id",
                      vec_col: str = "vector") -> DataFrame:
    """Expand a base vector set and perturb each copy with reproducible Gaussian noise
    (Box-Muller over two uniforms of one md5 value per component), then re-normalise; a vector
    whose norm is zero becomes null components.  Every intermediate is bound once, so the work
    is linear in the dimension."""
    exp = expand_documents(vectors.withColumn("__base", F.col(id_col).cast("string")), target_count,
                           order_by, "repeat", id_col, text_col="__none")

    def noise(h):
        return F.sqrt(-2.0 * F.log(_hash_unit(h, 1))) * F.cos(2.0 * math.pi * _hash_unit(h, 9))

    def noisy(x, i):
        key = [F.col("__base"), F.coalesce(F.col("repeat_id"), F.lit(-1)).cast("string"), i.cast("string"), F.lit(str(seed))]
        return x.cast("double") + F.lit(sigma) * let(F.md5(F.concat_ws(":", *key)), noise)

    def unit(raw):
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(raw, lambda x: F.try_divide(x, n).cast("float")))

    return exp.withColumn(vec_col, let(F.transform(F.col(vec_col), noisy), unit)).drop("__base")
