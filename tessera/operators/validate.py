"""Collection validation (A1, O2, X6, X7, P14) in one scan.

Lines are classified as blank (empty after strip), malformed (not exactly one tab after
strip) or valid; duplicate ids are valid and reported.  ``check_lines`` > 0 classifies only
lines up to that line number (exactly, unlike the reference's slip past invalid lines);
the default classifies every line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import id_too_long, preview, py_strip
from .ordinals import dense_id


def classify_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    s = py_strip(F.col(value_col))
    parts = F.split(s, "\t")
    kind = (F.when(s == F.lit(""), F.lit("blank"))
            .when(F.size(parts) != 2, F.lit("malformed"))
            .otherwise(F.lit("valid")))
    return lines.select("*", kind.alias("kind"),
                        F.when(F.size(parts) == 2, parts[0]).alias("id"),
                        F.when(F.size(parts) == 2, parts[1]).alias("text"))


def validate_collection(lines: DataFrame, value_col: str = "value", check_lines: int = 0,
                        line_no_col: str | None = None) -> DataFrame:
    """A1: one row of counts, length statistics and the verdict.  ``check_lines`` needs the lines
    to be numbered (``line_no_col``, from 1; see ``number_lines``)."""
    if check_lines and not line_no_col:
        raise ValueError("check_lines needs line_no_col")
    c = classify_lines(lines, value_col)
    if check_lines:
        c = c.withColumn("kind", F.when(F.col(line_no_col) <= check_lines, F.col("kind")))
    valid = F.col("kind") == "valid"
    length = F.when(valid, F.length("text"))
    agg = c.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(valid).alias("valid_lines"),
        F.count_if(F.col("kind") == "blank").alias("empty_lines"),
        F.count_if(F.col("kind") == "malformed").alias("malformed_lines"),
        F.count_distinct(F.when(valid, F.col("id"))).alias("unique_ids"),
        F.round(F.avg(length), 6).alias("avg_length"),
        F.min(length).cast("bigint").alias("min_length"),
        F.max(length).cast("bigint").alias("max_length"),
        F.count_if(valid & id_too_long(F.col("id"))).alias("ids_over_64_bytes"),
    )
    return agg.select(
        "*", (F.col("valid_lines") - F.col("unique_ids")).alias("duplicate_ids"),
        ((F.col("malformed_lines") == 0) & (F.col("valid_lines") > 0)).alias("passed"))


def duplicate_id_lines(lines: DataFrame, order_by: list[str], value_col: str = "value") -> DataFrame:
    """O2 over a line table: valid lines whose id already occurred earlier.  The lines are range-sorted
    by id and place, so the lines of one id spread over tasks; an occurrence is a line's place in
    that order less the first of its id."""
    c = classify_lines(lines, value_col).filter(F.col("kind") == "valid")
    placed = dense_id(c, ["id", *order_by], name="__place")
    firsts = placed.groupBy("id").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    return (placed.join(firsts, "id").withColumn("occurrence", F.col("__place") - F.col("__first") + 1)
            .filter(F.col("occurrence") > 1).drop("__place", "__first", "__n"))


def number_lines(lines: DataFrame, order_by: list[str], name: str = "line_no") -> DataFrame:
    """1-based line numbers in file order (distributed dense ordinal)."""
    return dense_id(lines, order_by, name=name, start=1)


def first_errors(lines: DataFrame, order_by: list[str], n: int = 5, value_col: str = "value") -> DataFrame:
    """The first ``n`` malformed lines, in line order."""
    c = classify_lines(lines, value_col).filter(F.col("kind") == "malformed")
    return c.orderBy(*order_by).limit(n)


def numbered_errors(lines: DataFrame, order_by: list[str], n: int = 5, value_col: str = "value") -> DataFrame:
    """X7 with the errors' line numbers (``line_no``, from 1): only these ``n`` lines are numbered, by
    counting the lines before each; ``order_by`` names every line."""
    found = first_errors(lines, order_by, n, value_col).select(*order_by, value_col)
    rows = found.collect()  # at most n
    at = F.struct(*order_by)
    counts = [F.count_if(at < F.struct(*[F.lit(r[c]).cast(lines.schema[c].dataType).alias(c) for c in order_by])).alias(f"c{i}") for i, r in enumerate(rows)]
    before = lines.agg(*counts).first() if rows else []
    schema = T.StructType([*found.schema.fields, T.StructField("line_no", T.LongType())])
    return lines.sparkSession.createDataFrame([(*r, before[i] + 1) for i, r in enumerate(rows)], schema)


def head_preview(collection: DataFrame, order_by: list[str], n: int = 3, width: int = 80) -> DataFrame:
    """First ``n`` rows with a ``width``-character preview."""
    return (collection.orderBy(*order_by).limit(n)
            .select("id", preview("text", width).alias("preview")))
