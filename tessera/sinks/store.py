"""Vector store writer.

Layout (all Parquet, all immutable)::

    {root}/_meta/                 one row: attributes map + total_vectors, vector_dim, dtype, ...
    {root}/files/{write}/...      pos BIGINT, id STRING, vector ARRAY<FLOAT>, sorted by pos
    {root}/_manifest/v=000001/    one row per file of that version: path, lo, hi, rows, bytes

A write that touches no stored position adds its files to the current version.  Any other makes
the next version: files that its range touches are replaced by the rest of their rows, all others
stay as they are and are named by the new manifest, too.  It is written beside the others and
renamed into place, so a version is there whole or not at all, readers keep the version they
began with, and of two writers of one version the second fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinals import dense_id

DTYPE_BYTES = {"float16": 2, "float32": 4, "float64": 8}


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


MANIFEST = "path string, lo bigint, hi bigint, rows bigint, bytes bigint"


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, jroot = _fs(spark, f"{root.rstrip('/')}/_manifest")
    if not fs.exists(jroot):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(jroot)]
    return sorted(int(name[2:]) for name in names if name.startswith("v="))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The files of a version (default: the latest)."""
    vs = versions(spark, root)
    if not vs:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(_version_path(root, vs[-1] if version is None else version))


def _version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/_manifest/v={version:06d}"


def store_schema(spark: SparkSession, root: str) -> str:
    kind = "double" if _meta(spark, root)["dtype"] == "float64" else "float"
    return f"pos bigint, id string, vector array<{kind}>"


def _add_files(spark: SparkSession, root: str, data: DataFrame, n: int, meta) -> DataFrame:
    """Writes (pos, id, vector) rows as sorted files of disjoint ranges; returns their manifest rows."""
    folder = f"files/{uuid.uuid4().hex[:12]}"
    nfiles = max(1, -(-n // max(int(meta["chunk_size"]) * 10, 1)))
    row_bytes = int(meta["vector_dim"]) * DTYPE_BYTES.get(meta["dtype"], 4) + 48
    path = f"{root.rstrip('/')}/{folder}"
    (data.repartitionByRange(nfiles, "pos").sortWithinPartitions("pos").write
     .option("compression", meta["compression"])
     .option("parquet.block.size", str(max(1 << 20, int(meta["chunk_size"]) * row_bytes))).parquet(path))
    return (spark.read.parquet(path).select("pos", "_metadata.file_name", "_metadata.file_size")
            .groupBy(F.concat(F.lit(folder + "/"), F.col("file_name")).alias("path"))
            .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("rows"), F.max("file_size").alias("bytes")))


def _publish(spark: SparkSession, root: str, files: DataFrame, version: int) -> None:
    top = f"{root.rstrip('/')}/_manifest"
    draft, target = f"{top}/_draft-{uuid.uuid4().hex[:12]}", _version_path(root, version)
    files.coalesce(1).write.parquet(draft)
    fs, jdraft = _fs(spark, draft)
    jtarget = _fs(spark, target)[1]
    if fs.exists(jtarget) or not fs.rename(jdraft, jtarget):
        raise RuntimeError(f"version {version} of {root} was written by another job")


def create_store(spark: SparkSession, root: str, total_vectors: int | None, vector_dim: int,
                 dtype: str = "float32", metadata: dict | None = None, chunk_size: int = 10000,
                 compression: str = "zstd") -> str:
    """K2: declare a store (attributes only; data arrives through :func:`write_batch`)."""
    attrs = {str(k): str(v) for k, v in (metadata or {}).items()}
    row = [(attrs, total_vectors, int(vector_dim), dtype, int(chunk_size), compression)]
    (spark.createDataFrame(row, "attributes map<string,string>, total_vectors long, vector_dim int, "
                                "dtype string, chunk_size int, compression string")
     .coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/_meta"))
    return root


def _meta(spark: SparkSession, root: str):
    return spark.read.parquet(f"{root.rstrip('/')}/_meta").first()


def write_batch(spark: SparkSession, root: str, df: DataFrame, start_idx: int = 0,
                order_by: list[str] | str = "pos", vector_col: str = "vector", id_col: str = "id") -> int:
    """K3: write ``df`` at positions ``start_idx + dense ordinal(order_by)``; returns the
    version written.  Existing rows in the range are replaced; only files that hold such rows are
    written anew."""
    meta = _meta(spark, root)
    dt = {"float16": "float", "float32": "float", "float64": "double"}.get(meta["dtype"], "float")
    numbered = dense_id(df, order_by, name="__ord")
    new = numbered.select((F.col("__ord") + F.lit(start_idx)).alias("pos"),
                          F.col(id_col).cast("string").alias("id"),
                          F.col(vector_col).cast(f"array<{dt}>").alias("vector"))
    n = numbered.count()
    vs = versions(spark, root)
    if not n and vs:
        return vs[-1]
    end = start_idx + n
    old = manifest(spark, root)
    touched = (F.col("lo") < end) & (F.col("hi") >= start_idx)
    hit = old.where(touched).collect()  # the files of the written range
    files = _add_files(spark, root, new, n, meta) if n else old
    if vs and not hit:
        files.coalesce(1).write.mode("append").parquet(_version_path(root, vs[-1]))
        return vs[-1]
    files = files.unionByName(old.where(~touched)) if n else old
    # what the touched files hold below and above the range
    for side, own in ((F.col("pos") < start_idx, [r for r in hit if r["lo"] < start_idx]), (F.col("pos") >= end, [r for r in hit if r["hi"] >= end])):
        if own:
            rows = spark.read.schema(store_schema(spark, root)).parquet(*[f"{root.rstrip('/')}/{r['path']}" for r in own]).where(side)
            files = files.unionByName(_add_files(spark, root, rows, sum(r["rows"] for r in own), meta))
    version = vs[-1] + 1 if vs else 1
    _publish(spark, root, files, version)
    return version


def write_vectors_iter(spark: SparkSession, root: str, vectors: DataFrame, ids: DataFrame,
                       on: str = "pos", start_idx: int = 0) -> int:
    """K4: pair two position-keyed inputs (inner join = stops at the shorter one) and write."""
    paired = vectors.join(ids, on, "inner")
    return write_batch(spark, root, paired, start_idx=start_idx, order_by=on)


def estimate_store_size(total_vectors, vector_dim, dtype: str = "float32",
                        compression_ratio: float = 0.7) -> Column:
    """MB = N * dim * bytes / 1024^2 * ratio (unknown dtype counts 4 bytes)."""
    n = F.col(total_vectors) if isinstance(total_vectors, str) else total_vectors
    d = F.col(vector_dim) if isinstance(vector_dim, str) else vector_dim
    b = DTYPE_BYTES.get(dtype, 4)
    return n.cast("double") * d * F.lit(b) / F.lit(1024.0 * 1024.0) * F.lit(compression_ratio)
