"""K1: write a TSV collection ``{n}<TAB>{text}`` with dense 0-based ids in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import dense_id


def collection_lines(df: DataFrame, order_by: list[str] | str, text_col: str = "text") -> DataFrame:
    """Dense id over ``order_by`` and the line ``id<TAB>text``.  A CR inside the text would
    split the line on re-read, so it is mapped to a space here (documented deviation)."""
    numbered = dense_id(df, order_by, name="id")
    text = F.translate(F.col(text_col), "\r", " ")
    return numbered.select("id", text.alias("text"),
                           F.concat_ws("\t", F.col("id").cast("string"), text).alias("value"),
                           *([order_by] if isinstance(order_by, str) else order_by))


def write_collection(df: DataFrame, path: str, order_by: list[str] | str, text_col: str = "text",
                     mode: str = "errorifexists") -> str:
    """Writes part files whose name order is the id order: the numbered ranges are written as
    they stand, one file per range."""
    collection_lines(df, order_by, text_col).select("value").write.mode(mode).text(path)
    return path
