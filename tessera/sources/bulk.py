"""Bulk NDJSON import side.

``read.text(lineSep='\\n{"index":')`` yields one record per action/document pair: a raw
newline cannot occur inside a JSON value, so the separator only matches where an action
line starts (documents start with ``{"text"``).  The first record of a file keeps the
``{"index":`` prefix; the others get it back.  Blank lines inside a record are dropped, a
record without a document line (odd last line) is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators.ordinals import batch_no, dense_id

_SEP = '\n{"index":'

ACTION_SCHEMA = "index struct<_index: string, _id: string>"


def read_bulk_ndjson(spark: SparkSession, path: str, doc_schema: str,
                     index_override: str | None = None) -> DataFrame:
    """``(pos, _index, _id, doc struct)`` with ``pos`` the 0-based pair ordinal in file order."""
    raw = (spark.read.option("lineSep", _SEP).text(path)
           .select("value", F.col("_metadata.file_path").alias("__file"),
                   F.input_file_block_start().alias("__block"),
                   F.monotonically_increasing_id().alias("__row")))
    lines = F.filter(F.split(F.col("value"), "\n"), lambda x: py_strip(x) != F.lit(""))
    rec = raw.select("__file", "__block", "__row", lines.alias("__l")).filter(F.size("__l") >= 2)
    first = F.col("__l")[0]
    action = F.when(first.startswith('{"index":'), first).otherwise(F.concat(F.lit('{"index":'), first))
    parsed = rec.select("__file", "__block", "__row",
                        F.from_json(action, ACTION_SCHEMA).alias("a"),
                        F.from_json(F.col("__l")[1], doc_schema).alias("doc"))
    numbered = dense_id(parsed, ["__file", "__block", "__row"], name="pos", bucket_prefix=2)
    idx = F.lit(index_override) if index_override else F.col("a.index._index")
    return numbered.select("pos", idx.alias("_index"), F.col("a.index._id").alias("_id"), "doc")


def bulk_import_summary(items: DataFrame, batch_size: int = 500, pos_col: str = "pos",
                        error_col: str = "error") -> DataFrame:
    """K9: per request batch and in total (``batch_no`` null): items indexed (a failed item
    still counts, as in the bulk response) and items with an error."""
    b = items.select(batch_no(pos_col, batch_size).alias("batch_no"), F.col(error_col))
    return (b.rollup("batch_no")
            .agg(F.count(F.lit(1)).alias("indexed"), F.count_if(F.col(error_col).isNotNull()).alias("errors")))
