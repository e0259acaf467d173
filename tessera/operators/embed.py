"""Embedding.

``embed`` runs a caller-supplied ``list[str] -> ndarray`` function over Arrow batches inside
``mapInArrow`` (map-only, no shuffle).  The function is built once per Python worker from a
factory and cached.  ``hash_embed`` is the built-in deterministic embedder (signed feature
hashing of lower-cased letter/digit tokens, L2-normalised); it exists as SQL (cells, used for
analysis and by the oracle) and as a numpy function with identical output for ``embed``.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN_SPLIT, tokens, wrap_instruction
from ..session import cut_lineage, ship_package
from .bounded import spread

# one embedding function per Python worker and ``cache_key`` of its factory
_WORKER_CACHE: dict[object, Callable] = {}
# tokens whose cells a worker remembers: a few MB each worker, the frequent ones come first
_CACHED_TOKENS = 1 << 15


def _resolve(factory) -> Callable:
    key = getattr(factory, "cache_key", None)
    if key is None:  # nothing names the model, so nothing may be shared between tasks
        return factory()
    fn = _WORKER_CACHE.get(key)
    if fn is None:
        fn = factory()
        _WORKER_CACHE[key] = fn
    return fn


def embed(df: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], *,
          text_col: str = "text", id_col: str = "id", dim: int | None = None,
          batch_size: int = 128, on_error: str = "fail", keep: list[str] | None = None,
          max_concurrency: int | None = None, vector_type: str = "float") -> DataFrame:
    """``(id, [keep...], vector array<float>, ok, error)``.

    ``on_error='fail'`` fails the job on any failed batch (export policy);
    ``on_error='null'`` keeps the rows of a failed batch with a null vector, ``ok=false`` and the
    ``error`` (store policy, counted downstream).  Rows stay keyed by id, so results
    can never be paired with the wrong document.  ``max_concurrency`` bounds the number of
    tasks calling the model at once (the reference's in-flight request limit).
    ``vector_type='double'`` keeps float64 vectors (default float32, P15).
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    ship_package(df.sparkSession)
    keep = list(keep or [])
    fields = [df.schema[id_col]] + [df.schema[k] for k in keep] + [
        T.StructField("vector", T.ArrayType(T.FloatType() if vector_type == "float" else T.DoubleType())),
        T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]
    np_type = np.float32 if vector_type == "float" else np.float64
    schema = T.StructType(fields)
    sel = df.select(F.col(id_col), *keep, F.col(text_col).alias("__t"))
    # at most max_concurrency tasks call the model at once; the scan keeps its own tasks
    sel = spread(sel, max_concurrency)

    list_type = pa.list_(pa.from_numpy_dtype(np_type))

    def run(batches):
        fn = _resolve(factory)
        for whole in batches:
            # a batch of texts at a time leaves Arrow, whatever the length of what Spark hands over
            for s in range(0, whole.num_rows, batch_size):
                part = whole.slice(s, batch_size)
                texts = [t if t is not None else "" for t in part.column("__t").to_pylist()]
                n = len(texts)
                try:
                    vecs = np.asarray(fn(texts), dtype=np_type)
                    if vecs.shape[0] != n or (dim is not None and vecs.shape[1] != dim):
                        raise ValueError(f"embedding batch shape {vecs.shape} for {n} texts")
                    width = vecs.shape[1]
                    vcol = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(vecs.ravel())).cast(list_type)
                    ok, error = True, None
                except Exception as e:
                    if on_error == "fail":
                        raise
                    vcol, ok, error = pa.nulls(n, list_type), False, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(1 + len(keep))] + [vcol, pa.array([ok] * n), pa.array([error] * n, pa.string())],
                    names=[id_col, *keep, "vector", "ok", "error"])

    return sel.mapInArrow(run, schema)


def embed_with_instruction(df: DataFrame, factory, template: str | None, *, text_col: str = "text",
                           **kw) -> DataFrame:
    """P9 wrapping, then E1 (order never matters: rows are keyed)."""
    wrapped = df.withColumn("__wrapped", wrap_instruction(text_col, template))
    return embed(wrapped, factory, text_col="__wrapped", **kw)


# ----------------------------------------------------------------- hash embedder

def hash_bucket(token: Column, dim: int) -> Column:
    return _bucket_of(F.md5(token), dim)


def hash_sign(token: Column) -> Column:
    return _sign_of(F.md5(token))


def _bucket_of(h: Column, dim: int) -> Column:
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int")


def _sign_of(h: Column) -> Column:
    return F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, F.lit(1)).otherwise(F.lit(-1))


def hash_embed_grouped(df: DataFrame, dim: int = 64, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """E3 per document: ``(id, cells array<struct<bucket, w>>, norm)`` with the raw signed
    counts.  Tokens are folded to (id, bucket) cells map-side before the first shuffle; the
    second aggregation gathers at most ``dim`` cells per document."""
    tok = df.select(F.col(id_col).alias("__id"), tokens(text_col).alias("__toks")) \
        .select("__id", F.explode("__toks").alias("__t")).select("__id", F.md5("__t").alias("__h"))
    cells = (tok.select("__id", _bucket_of(F.col("__h"), dim).alias("bucket"), _sign_of(F.col("__h")).alias("s"))
             .groupBy("__id", "bucket").agg(F.sum("s").alias("w"))
             .filter(F.col("w") != 0))
    return cells.groupBy(F.col("__id").alias(id_col)).agg(
        F.collect_list(F.struct("bucket", "w")).alias("cells"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def hash_embed_cells(df: DataFrame, dim: int = 64, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """E3 in SQL: ``(id, bucket, value)`` non-zero cells of the normalised vector."""
    g = hash_embed_grouped(df, dim, id_col, text_col)
    return g.select(F.col(id_col), F.inline("cells"), "norm").select(
        id_col, "bucket", (F.col("w") / F.col("norm")).alias("value"))



class HashEmbedder:
    """The numpy twin of :func:`hash_embed_cells` (same tokens, buckets, signs, norm)."""

    def __init__(self, dim: int = 64):
        import regex

        self.dim = dim
        self._split = regex.compile(TOKEN_SPLIT)
        self._cache: dict[str, tuple[int, int]] = {}

    def _cell(self, tok: str) -> tuple[int, int]:
        c = self._cache.get(tok)
        if c is None:
            h = hashlib.md5(tok.encode("utf-8")).hexdigest()
            c = (int(h[:8], 16) % self.dim, 1 if int(h[8], 16) < 8 else -1)
            if len(self._cache) < _CACHED_TOKENS:
                self._cache[tok] = c
        return c

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for r, t in enumerate(texts):
            for tok in self._split.split(t.lower()):
                if tok:
                    b, s = self._cell(tok)
                    out[r, b] += s
        n = np.linalg.norm(out, axis=1)
        nz = n > 0
        out[nz] /= n[nz, None]
        return out


def hash_embedder_factory(dim: int = 64):
    def make():
        return HashEmbedder(dim)
    make.cache_key = f"hash-embedder:{dim}"
    return make


def generate_and_store(df: DataFrame, factory, store_path: str, *, text_col: str = "text",
                       id_col: str = "id", order_by: list[str] | str = "id", dim: int,
                       batch_size: int = 128, model_name: str = "hash", extra_meta: dict | None = None):
    """Embed a corpus and write it to a vector store at dense positions; returns a one-row
    DataFrame with counts, failures, seconds and vectors per second."""
    from ..sinks.store import create_store, write_batch

    spark = df.sparkSession
    t0 = time.time()
    vec = embed(df, factory, text_col=text_col, id_col=id_col, dim=dim, batch_size=batch_size,
                on_error="null", keep=[c for c in ([order_by] if isinstance(order_by, str) else order_by)
                                       if c != id_col])
    # the ordinals and the files read the vectors several times: the model runs once
    vec = cut_lineage(vec)
    meta = {"model_name": model_name, "batch_size": str(batch_size), "async_mode": "false"}
    meta.update(extra_meta or {})
    create_store(spark, store_path, total_vectors=None, vector_dim=dim, metadata=meta)
    version = write_batch(spark, store_path, vec.withColumn("id", F.col(id_col).cast("string")),
                          start_idx=0, order_by=order_by)
    from ..sources.store import read_store
    stored = read_store(spark, store_path)
    stats = stored.agg(F.count(F.lit(1)).alias("total_vectors"),
                       F.count_if(F.col("vector").isNull()).alias("failed_vectors")).first()
    secs = time.time() - t0
    row = (int(stats["total_vectors"]), int(stats["failed_vectors"]), float(secs),
           float(stats["total_vectors"]) / secs if secs > 0 else 0.0, int(version))
    return spark.createDataFrame([row], "total_vectors long, failed_vectors long, seconds double, "
                                        "vectors_per_second double, version int")
