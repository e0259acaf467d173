"""Approximate search (V7): inverted-file probe search over KMeans cells, and LSH.

Cells are trained with ``pyspark.ml.clustering.KMeans`` (optionally on a training fraction
— the model, never the result, is fitted on a sample); every corpus vector is assigned to
its nearest centroid; every query probes its ``nprobe`` nearest cells.  Scoring runs
map-side like the exact search, but a task only multiplies a query against rows of the
cells that query probes, so work drops by about ``cells / nprobe``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blockscan import add_products, columns, dense, scan, search_blocks, unit
from .bounded import DEFAULT_BROADCAST_BYTES
from .search import _unit, merge_blocks, precisions


def train_cells(corpus: DataFrame, cells: int, vec_col: str = "vector", seed: int = 42,
                max_iter: int = 20, train_fraction: float | None = None) -> np.ndarray:
    """Unit-normalised KMeans centroids (``cells x dim``)."""
    vectors = corpus.where(F.col(vec_col).isNotNull()).select(F.transform(vec_col, lambda x: x.cast("double")).alias("__v"))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))
    # null and zero vectors belong to no cell
    feats = (vectors.select("__v", norm.alias("__n")).where(F.col("__n") > 0)
             .select(array_to_vector(F.transform("__v", lambda x: x / F.col("__n"))).alias("features")).persist())
    if train_fraction:
        feats = feats.sample(False, train_fraction, seed)
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, initMode="k-means||").fit(feats)
    feats.unpersist()
    cent = np.array([c for c in model.clusterCenters()], dtype=np.float64)
    return _unit(cent)[0]


def cell_means(corpus: DataFrame, cell_col: str, vec_col: str = "vector") -> np.ndarray:
    """Unit-normalised mean vectors of given cells, in the order of their names (one row per cell)."""
    means = (corpus.where(F.col(cell_col).isNotNull()).select(cell_col, F.posexplode(vec_col).alias("i", "x")).groupBy(cell_col, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
             .groupBy(cell_col).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("m")).orderBy(cell_col)
             .select("m.m").collect())
    return _unit(np.array([r[0] for r in means], dtype=np.float64))[0]


def _ivf_fn(table, dim, cent, nprobe, k, id_col):
    q, ok = unit(dense(table["__qv"], dim)[0])
    if not ok.any():
        return None
    q, qids = q[ok], table["__qid"].combine_chunks().filter(pa.array(ok))
    probes = np.argsort(-(q @ cent.T), axis=1, kind="stable")[:, :nprobe]
    by_cell = {c: np.flatnonzero((probes == c).any(axis=1)) for c in range(cent.shape[0])}

    def absorb(best, batch, at):
        c, ok = unit(dense(batch.column("__v"), dim)[0])
        cell = np.argmax(c @ cent.T, axis=1)
        q_low, c_low, err = precisions(q, c, True)
        for x in np.unique(cell[ok]):
            if len(asked := by_cell[int(x)]):
                add_products(best, q, c, q_low, c_low, err, asked, np.flatnonzero(ok & (cell == x)), at)

    return scan(qids, len(q), k, id_col, absorb)


def knn_ivf(queries: DataFrame, corpus: DataFrame, k: int = 10, cells: int = 16, nprobe: int = 4, *,
            query_id: str = "qid", query_vec: str = "vector", id_col: str = "id", vec_col: str = "vector",
            decimals: int = 6, seed: int = 42, centroids: np.ndarray | None = None,
            max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, partitions: int | None = None) -> DataFrame:
    """V7: ``(qid, id, score, rank)`` from the probed cells only; queries in size-bounded blocks."""
    cent = centroids if centroids is not None else train_cells(corpus, cells, vec_col, seed)

    def merge(part):
        return merge_blocks([part], [F.col("score").desc(), F.col(id_col).asc()], k, ["qid", id_col, "score"], decimals)
    return search_blocks(columns(queries, query_id, query_vec, ("__qid", "__qv")), columns(corpus, id_col, vec_col, ("__id", "__v")),
                         64 + 32 * k + 8 * nprobe, max_broadcast_bytes, id_col,
                         lambda table, dim: _ivf_fn(table, dim, cent, nprobe, k, id_col), merge, partitions)


def _lsh_fn(table, dim, tables, k, threshold, id_col):
    """Rows of equal hashes, a group with the queries that share one of them at a time."""
    q, qids, q_hash = dense(table["__qv"], dim)[0], table["__qid"].combine_chunks(), dense(table["__h"], tables)[0]
    if len(q) == 0:
        return None

    def absorb(best, batch, at):
        c, c_hash = dense(batch.column("__v"), dim)[0], dense(batch.column("__h"), tables)[0]
        q_low, c_low, err = precisions(q, c, True)
        hashes, group = np.unique(c_hash, axis=0, return_inverse=True)
        order = np.argsort(group, kind="stable")
        for h, rows in zip(hashes, np.split(order, np.cumsum(np.bincount(group))[:-1])):
            if len(asked := np.flatnonzero((q_hash == h).any(axis=1))):
                add_products(best, q, c, q_low, c_low, err, asked, rows, at)

    return scan(qids, len(q), k, id_col, absorb, least=1 - threshold * threshold / 2)


def knn_lsh(queries: DataFrame, corpus: DataFrame, k: int, threshold: float, *, bucket_length: float = 1.0,
            tables: int = 4, seed: int = 42, query_id: str = "qid", query_vec: str = "vector",
            id_col: str = "id", vec_col: str = "vector", decimals: int = 6,
            max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, partitions: int | None = None) -> DataFrame:
    """V7 (LSH form): ``(qid, id, score, rank)``; Euclidean LSH on unit vectors, where distance
    ``d`` is cosine ``1 - d^2 / 2``; candidates (pairs that share a hash) within ``threshold``, the best
    ``k`` of them.  Repeated rows of equal id and vector count once.  Spark's LSH model hashes both
    sides; the pairs are scored in blocks, never listed, as wide buckets hold most of them."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH

    def units(df, id_, vec, names):
        norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        unit_rows = (df.where(F.col(vec).isNotNull()).select(F.col(id_).alias(names[0]), F.col(vec).alias("__v"), norm.alias("__n"))
                     .where((F.col("__n") > 0) & (F.col("__n") < float("inf"))))
        return (unit_rows.select(names[0], F.transform("__v", lambda x: x.cast("double") / F.col("__n")).alias(names[1])).distinct()
                .withColumn("features", array_to_vector(names[1])))
    a, b = units(queries, query_id, query_vec, ("__qid", "__qv")), units(corpus, id_col, vec_col, ("__id", "__v"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(b)
    hashes = F.array(*[F.get(vector_to_array(F.get("h", F.lit(t))), F.lit(0)) for t in range(tables)]).alias("__h")
    q, c = model.transform(a).select("__qid", "__qv", hashes), model.transform(b).select("__id", "__v", hashes)

    def merge(part):
        return merge_blocks([part], [F.col("score").desc(), F.col(id_col).asc()], k, ["qid", id_col, "score"], decimals)
    return search_blocks(q, c, 64 + 32 * k + 8 * tables, max_broadcast_bytes, id_col,
                         lambda table, dim: _lsh_fn(table, dim, tables, k, threshold, id_col), merge, partitions)
