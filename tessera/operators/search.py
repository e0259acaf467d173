"""Exact vector search.

Plan at scale: the query matrix is measured and shipped to every task in blocks of at most
``max_broadcast_bytes``; each corpus partition multiplies its Arrow batches against the
block with numpy, keeps a partial top-k per query (see ``blockscan``), and a
``row_number`` per query — which Spark runs as a partial ``WindowGroupLimit`` before the
shuffle — merges the partial lists of a block before the next one is read.  No pair table is
ever built, so the shuffle carries at most ``partitions x queries x k`` rows regardless of
corpus size; ``partitions`` sets how many tasks share the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blockscan import RANK_DECIMALS, add_products, columns, dense, scan, search_blocks, unit  # noqa: F401
from .bounded import DEFAULT_BROADCAST_BYTES


def _matrix(series: pd.Series, dim: int) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim), dtype=np.float64)
    try:
        stacked = np.stack(series.to_numpy()).astype(np.float64)
        if stacked.shape == (len(series), dim):
            return stacked
    except (ValueError, TypeError):
        pass  # ragged or null rows: fill row by row (those rows stay zero = excluded)
    out = np.zeros((len(series), dim), dtype=np.float64)
    for i, v in enumerate(series):
        if v is not None and len(v) == dim:
            out[i] = v
    return out


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(m, axis=1)
    ok = norms > 0
    out = np.zeros_like(m)
    out[ok] = m[ok] / norms[ok, None]
    return out, ok


def _keep_best(best, frame, k, id_name):
    """The top k rows per query of the rows so far and the new ones."""
    both = frame if best is None else pd.concat([best, frame], ignore_index=True)
    both = both.sort_values(["__qi", "score", id_name], ascending=[True, False, True], kind="mergesort", na_position="first")
    return both.groupby("__qi", sort=False).head(k)


def merge_blocks(parts: list[DataFrame], rank: list[Column], k: int, columns: list[str], decimals: int) -> DataFrame:
    """Merges the partial results of all query blocks: rank, cut, round."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return (both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*rank)))
            .filter(F.col("rank") <= k).withColumn("score", F.round("score", decimals)).select(*columns, "rank"))


def _settled(part: DataFrame, nblocks: int) -> DataFrame:
    """With several query blocks, a block's result is written before the next block is read, so
    the driver holds one block at a time."""
    return part if nblocks == 1 else cut_lineage(part)


def query_blocks(q: DataFrame, qid_col: str, row_bytes: int, max_bytes: int):
    """Yield pandas blocks of the query side, each within ``max_bytes`` (hash-split by id)."""
    n = q.count()
    nblocks = max(1, math.ceil(n * row_bytes / max_bytes))
    for b in range(nblocks):
        qb = q if nblocks == 1 else q.filter(F.pmod(F.xxhash64(qid_col), F.lit(nblocks)) == b)
        yield qb.toPandas()


def precisions(q: np.ndarray, c: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides in the precision of the first look, and the most its products err: single for unit
    vectors (twice the bound of their sums), double for others."""
    if cosine:
        return q.astype(np.float32), c.astype(np.float32), (q.shape[1] + 4) * 2.0**-23
    longest = max(1.0, float(np.linalg.norm(q, axis=1).max(initial=0)) * float(np.linalg.norm(c, axis=1).max(initial=0)))
    return q, c, 10.0**-RANK_DECIMALS + (q.shape[1] + 4) * 2.0**-51 * longest


def _exact_fn(table, dim, k, metric, id_col, has_part):
    """Brute force over a block of queries; with partitions, over the rows of equal values (a null
    value is no partition)."""
    q, ok = dense(table["__qv"], dim)
    if metric == "cosine":
        q, ok = unit(q)
    qids = table["__qid"].combine_chunks().filter(pa.array(ok))
    q = q[ok]
    q_parts = table["__qp"].to_pandas().to_numpy()[ok] if has_part else None
    if len(q) == 0:
        return None
    everyone = np.arange(len(q))
    by_part = {v: np.flatnonzero(q_parts == v) for v in pd.unique(q_parts[pd.notna(q_parts)])} if has_part else {}

    def absorb(best, batch, at):
        c, ok = dense(batch.column("__v"), dim)
        if metric == "cosine":
            c, ok = unit(c)
        q_low, c_low, err = precisions(q, c, metric == "cosine")
        if not has_part:
            add_products(best, q, c, q_low, c_low, err, everyone, np.flatnonzero(ok), at)
            return
        c_parts = batch.column("__p").to_pandas().to_numpy()
        for v in pd.unique(c_parts[ok & pd.notna(c_parts)]):
            if v in by_part:
                add_products(best, q, c, q_low, c_low, err, by_part[v], np.flatnonzero(ok & (c_parts == v)), at)

    return scan(qids, len(q), k, id_col, absorb)


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = 10, *,
              query_id: str = "qid", query_vec: str = "vector",
              id_col: str = "id", vec_col: str = "vector",
              metric: str = "cosine", partition_col: str | None = None,
              decimals: int = 6, max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, partitions: int | None = None) -> DataFrame:
    """Exact top-k per query: ``(qid, id, score, rank)``; ties by id; zero vectors excluded.

    ``partition_col`` (V8) restricts matches to rows whose partition value equals the
    query's.  Filters on ``corpus`` (V2, V20) are applied before the scan by Catalyst.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError("metric must be 'cosine' or 'dot'")
    q = columns(queries, query_id, query_vec, ("__qid", "__qv"), *([F.col(partition_col).alias("__qp")] if partition_col else []))
    c = columns(corpus, id_col, vec_col, ("__id", "__v"), *([F.col(partition_col).alias("__p")] if partition_col else []))

    def make(table, dim):
        return _exact_fn(table, dim, k, metric, id_col, bool(partition_col))

    def merge(part):
        return merge_blocks([part], [F.col("score").desc(), F.col(id_col).asc()], k, ["qid", id_col, "score"], decimals)
    return search_blocks(q, c, 32 + 32 * k, max_broadcast_bytes, id_col, make, merge, partitions)


def knn_filtered(queries: DataFrame, corpus: DataFrame, predicate, k: int = 10, **kw) -> DataFrame:
    """V2: scalar pre-filter, then exact search (the filter reaches the Parquet scan)."""
    return knn_exact(queries, corpus.filter(predicate), k, **kw)


def knn_partitioned(queries: DataFrame, corpus: DataFrame, partition_col: str, k: int = 10,
                    **kw) -> DataFrame:
    """V8: search inside the query's partition only."""
    return knn_exact(queries, corpus, k, partition_col=partition_col, **kw)


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """V9: per query |approx ∩ exact| / k, plus the mean over queries."""
    # the exact side is read once: it is as costly as the search
    a = approx.select("qid", id_col).distinct().withColumn("__hit", F.lit(True))
    e = exact.filter(F.col("rank") <= k).select("qid", id_col)
    return e.join(a, ["qid", id_col], "left").groupBy("qid").agg((F.count("__hit") / F.lit(k)).alias("recall"))


def mean_recall(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.round(F.avg("recall"), 6).alias("mean_recall"),
                         F.count(F.lit(1)).alias("queries"))
