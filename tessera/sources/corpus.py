"""Corpus readers.

Collections are ``(id STRING, text STRING)``.  Line-oriented input is read with
``spark.read.text`` (never the CSV reader: quoting rules would change the parsing), and
every reader keeps a line key ``(__file, __block, __row)`` so "input order" survives any
partitioning: files in name order, splits in offset order, rows in read order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import flatten_text, length_between, py_strip


def read_lines(spark: SparkSession, path: str, **opts) -> DataFrame:
    """Text lines with an order key: ``value, __file, __block, __row``."""
    return (spark.read.options(**opts).text(path)
            .select("value",
                    F.col("_metadata.file_path").alias("__file"),
                    F.input_file_block_start().alias("__block"),
                    F.monotonically_increasing_id().alias("__row")))


LINE_ORDER = ["__file", "__block", "__row"]


def parse_collection(lines: DataFrame, min_length: int = 10, max_length: int = 512,
                     value_col: str = "value") -> DataFrame:
    """Strip the line, keep exactly two tab-separated parts, keep texts whose length
    is in ``[min_length, max_length]``; the text itself is not stripped again."""
    parts = F.split(py_strip(F.col(value_col)), "\t")
    keep = [c for c in lines.columns if c.startswith("__")]
    return (lines.select(parts.alias("__parts"), *keep)
            .filter(F.size("__parts") == 2)
            .select(F.col("__parts")[0].alias("id"), F.col("__parts")[1].alias("text"), *keep)
            .filter(length_between("text", min_length, max_length)))


def read_collection(spark: SparkSession, path: str, min_length: int = 10, max_length: int = 512,
                    keep_order_key: bool = False) -> DataFrame:
    """A TSV collection ``id<TAB>text`` per line."""
    df = parse_collection(read_lines(spark, path), min_length, max_length)
    return df if keep_order_key else df.select("id", "text")


def json_text(value: Column, text_field: str = "text") -> Column:
    """S3 rule for one JSON line: the field's string value; ``''`` when the key is absent;
    null (= skip the row) for bad JSON, a non-object root, or a non-string / null value."""
    def read(v):
        field = F.variant_get(v, f"$.{text_field}", "variant")
        return (F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit(None).cast("string"))
                .otherwise(let(field, lambda x: F.when(x.isNull(), F.lit("")).when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")))))
    # a line is parsed once, however often the parsed value is named
    return let(F.try_parse_json(value), read)


def read_json_text(lines: DataFrame, text_field: str = "text", min_length: int = 10,
                   max_length: int = 512, value_col: str = "value") -> DataFrame:
    """S3 over a lines DataFrame: raw text, flattened (P1), length-filtered (F1).
    Keeps order-key columns (``__*``)."""
    keep = [c for c in lines.columns if c.startswith("__")]
    return (lines.select(json_text(F.col(value_col), text_field).alias("__raw"), *keep)
            .filter(F.col("__raw").isNotNull())
            .select(flatten_text("__raw").alias("text"), *keep)
            .filter(length_between("text", min_length, max_length)))


def read_parquet_text(df: DataFrame, text_field: str = "text", min_length: int = 10,
                      max_length: int = 512) -> DataFrame:
    """Any column stringified (null -> ``'None'`` as Python's ``str``), missing -> ``''``."""
    if text_field in df.columns:
        raw = F.coalesce(F.col(text_field).cast("string"), F.lit("None"))
    else:
        raw = F.lit("")
    keep = [c for c in df.columns if c != text_field]
    return (df.select(flatten_text(raw).alias("text"), *keep)
            .filter(length_between("text", min_length, max_length)))


def read_text_with_fallback(df: DataFrame, text_field: str = "text", min_length: int = 10,
                            max_length: int = 512) -> DataFrame:
    """The text field if the record has it, else ``content``, else ``''`` (presence, not
    null-coalescing); then P1 and F1."""
    if text_field in df.columns:
        raw = F.col(text_field)
    elif "content" in df.columns:
        raw = F.col("content")
    else:
        raw = F.lit("")
    keep = [c for c in df.columns if c not in (text_field, "content")]
    return (df.select(flatten_text(raw.cast("string")).alias("text"), *keep)
            .filter(length_between("text", min_length, max_length)))


def read_corpus(spark: SparkSession, path: str, fmt: str, text_field: str = "text",
                min_length: int = 10, max_length: int = 512, max_samples: int | None = None,
                order_by: list[str] | None = None) -> DataFrame:
    """Dispatch on format; returns flattened, filtered texts with an order key, the first
    ``max_samples`` accepted ones in its order.  Lines are ordered by file and place, Parquet rows by
    file and row position; a table has no order of its own, so ``max_samples`` needs ``order_by`` there."""
    from ..operators.sample import load_head
    if fmt == "json":
        out, order = read_json_text(read_lines(spark, path), text_field, min_length, max_length), LINE_ORDER
    elif fmt == "parquet":
        df = spark.read.parquet(path).withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
        out, order = read_parquet_text(df, text_field, min_length, max_length), ["__file", "__row"]
    elif fmt in ("table", "hub"):
        out, order = read_text_with_fallback(spark.table(path), text_field, min_length, max_length), order_by
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if max_samples is not None and not order:
        raise ValueError("max_samples of a table needs order_by")
    return load_head(out, max_samples, order_by or order)


def _plain(path: str) -> Column:
    """One spelling of local paths: readers write the scheme with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def dataset_catalog(spark: SparkSession, path: str, glob: str = "*.tsv") -> DataFrame:
    """Per file: name, line count (0 for an empty file), size in bytes."""
    # the listing reads no contents; an empty file has no lines, so only it knows of them
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
             .select(F.col("path"), F.col("length").alias("size_bytes")))
    lines = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
             .groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("lines")))
    return (files.withColumn("path", _plain("path")).join(lines.withColumn("file_path", _plain("file_path")), F.col("path") == F.col("file_path"), "left")
            .select(F.col("path").alias("file_path"), F.coalesce("lines", F.lit(0)).alias("lines"), "size_bytes"))


def utf8_check_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A2: per file, whether its lines decode as UTF-8.  Lines keep their bytes until they are
    looked at, so large files are checked split by split."""
    return (spark.read.option("pathGlobFilter", glob).text(path)
            .groupBy(_plain("_metadata.file_path").alias("path"))
            .agg(F.bool_and(F.is_valid_utf8("value")).alias("valid_utf8")))


def utf8_valid(c) -> Column:
    """A2 on a binary or string column."""
    col = F.col(c) if isinstance(c, str) else c
    return F.is_valid_utf8(col.cast("string"))
