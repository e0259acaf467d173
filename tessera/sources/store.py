"""Vector store readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.store import manifest, store_schema, versions

#: files up to which an ordered read lines them up; beyond, it sorts
ORDERED_FILES = 200


def _files(spark: SparkSession, root: str, version: int | None, start_idx: int, end_idx: int | None) -> list:
    """The files that hold the slice, by position."""
    files = manifest(spark, root, version).where(F.col("hi") >= start_idx)
    if end_idx is not None:
        files = files.where(F.col("lo") < end_idx)
    return files.orderBy("lo").collect()


def _scan(spark: SparkSession, root: str, files: list) -> DataFrame:
    schema = store_schema(spark, root)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/{r['path']}" for r in files])


def read_store(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return _scan(spark, root, _files(spark, root, version, 0, None))


def _slice(df: DataFrame, start_idx: int, end_idx: int | None) -> DataFrame:
    cond = F.col("pos") >= start_idx
    if end_idx is not None:
        cond = cond & (F.col("pos") < end_idx)
    return df.filter(cond)


def _ordered(spark: SparkSession, root: str, start_idx: int, end_idx: int | None, column: str) -> DataFrame:
    """The slice in position order, from the files that hold it: each is sorted and their ranges
    are disjoint, so one after the other (a partition each) they need no sort."""
    files = _files(spark, root, None, start_idx, end_idx)

    def part(own):
        return _slice(_scan(spark, root, own), start_idx, end_idx).select("pos", column)
    if not files or len(files) > ORDERED_FILES or any(a["hi"] >= b["lo"] for a, b in zip(files, files[1:])):
        return part(files).orderBy("pos")
    out = part(files[:1]).coalesce(1)
    for f in files[1:]:
        out = out.unionByName(part([f]).coalesce(1))
    return out


def read_vectors(spark: SparkSession, root: str, start_idx: int = 0, end_idx: int | None = None) -> DataFrame:
    """Rows ``[start, end)`` in position order; other files are not read."""
    return _ordered(spark, root, start_idx, end_idx, "vector")


def read_ids(spark: SparkSession, root: str, start_idx: int = 0, end_idx: int | None = None) -> DataFrame:
    """Same slice, ids only (the vector column is never read)."""
    return _ordered(spark, root, start_idx, end_idx, "id")


def store_metadata(spark: SparkSession, root: str) -> DataFrame:
    """The attribute row."""
    return spark.read.parquet(f"{root.rstrip('/')}/_meta")


def store_info(spark: SparkSession, root: str) -> DataFrame:
    """Path, size in MB and stored rows (from the manifest, no data read), dim, dtype."""
    vs = versions(spark, root)
    total = manifest(spark, root).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).first()
    size, stored = total["bytes"] or 0, total["rows"] or 0
    return store_metadata(spark, root).select(
        F.lit(root).alias("path"), F.lit(size / 1024.0 / 1024.0).alias("size_mb"),
        F.coalesce(F.col("total_vectors"), F.lit(stored)).alias("total_vectors"),
        F.lit(stored).cast("bigint").alias("stored_vectors"), F.col("vector_dim"),
        F.coalesce(F.col("dtype"), F.lit("unknown")).alias("dtype"),
        F.coalesce(F.col("attributes")["model_name"], F.lit("unknown")).alias("model_name"),
        F.lit(vs[-1] if vs else 0).alias("version"))
