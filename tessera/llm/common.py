"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: rows up to which a table may be broadcast; every use counts the rows first
BROADCAST_ROWS = 400_000
#: rows that a Python task holds as objects
ROWS_AT_ONCE = 512
#: a word is a run of anything but space and the control characters tab to carriage return
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder and reads it back: the lineage
    is cut and a lost executor costs at most the stage that reads the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound, else unchanged
    (then the join shuffles and adaptive execution splits hot keys).  ``df`` should be a
    materialised table, whose rows are counted from the files' metadata, or a filter of one."""
    return F.broadcast(df) if df.count() <= max_rows else df


def map_rows(df: DataFrame, function: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]],
             schema: str) -> DataFrame:
    """``mapInArrow`` over plain Python lists: ``function`` gets batches as column dicts and
    yields column dicts in the order of ``schema``."""
    ship_package(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        # a few hundred rows at a time become Python objects
        parts = (b.slice(at, ROWS_AT_ONCE).to_pydict() for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        for out in function(parts):
            yield pa.RecordBatch.from_pydict(dict(out), schema=target)

    return df.mapInArrow(run, schema)


def give_back_memory() -> None:
    """Returns what a task has freed to the system: a worker outlives its tasks, next to an
    executor whose later stages need the room."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def map_slices(df: DataFrame, column: str, function: Callable[[pa.RecordBatch, int], pa.RecordBatch]) -> DataFrame:
    """``df`` with the rows of ``function(batch, place)``, which gets a few hundred rows at a time and
    the place of ``column`` among them, and returns rows of the same columns.  Columns may have
    any names."""
    ship_package(df.sparkSession)
    place = df.columns.index(column)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                yield function(whole.slice(at, ROWS_AT_ONCE), place)
        give_back_memory()

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
