"""Binary quantisation and Hamming-shortlist search (V5, V6).

Codes: bit ``i`` of word ``i // 64`` is set when component ``i`` is positive (64 dims = one
long).  Search: per query, the ``k * oversample`` nearest codes by Hamming distance (ties by
id) form the shortlist, which is rescored with the exact cosine.  Each task keeps its own
top ``k * oversample`` by Hamming — a superset of its share of the global shortlist — with the
exact score attached, so the global shortlist and the rescoring are exact after one
per-query window merge.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blockscan import add_hamming, columns, dense, scan, search_blocks, unit
from .bounded import DEFAULT_BROADCAST_BYTES

# corpus rows packed at a time
_BATCH = 1 << 14


def binary_codes(vec, dim: int) -> Column:
    """V5: ``array<bigint>`` of ceil(dim / 64) sign-bit words."""
    v = F.col(vec) if isinstance(vec, str) else vec
    words = math.ceil(dim / 64)

    def word(w):
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
            lambda acc, b: acc.bitwiseOR(
                F.when(((w * 64 + b) < F.size(v)) & (F.get(v, w * 64 + b) > 0),
                       F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))))

    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def _pack(m: np.ndarray) -> np.ndarray:
    """numpy twin of :func:`binary_codes` -> uint64 words."""
    n, d = m.shape
    words = math.ceil(d / 64)
    bits = np.zeros((n, words * 64), dtype=np.uint8)
    bits[:, :d] = m > 0
    out = np.zeros((n, words), dtype=np.uint64)
    for w in range(words):
        chunk = bits[:, w * 64:(w + 1) * 64].astype(np.uint64)
        out[:, w] = (chunk << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _hamming(qc: np.ndarray, cc: np.ndarray) -> np.ndarray:
    """Distances word by word, so memory stays at queries x rows whatever the dimension."""
    out = np.zeros((len(qc), len(cc)), np.int64)
    for w in range(qc.shape[1]):
        out += np.bitwise_count(qc[:, w, None] ^ cc[None, :, w])
    return out


def _hamming_fn(table, dim, shortlist, id_col):
    raw, _ = dense(table["__qv"], dim)
    ok = unit(raw)[1]
    if not ok.any():
        return None
    raw, qids = raw[ok], table["__qid"].combine_chunks().filter(pa.array(ok))
    q_codes, q = _pack(raw), unit(raw)[0]

    def absorb(best, batch, at):
        raw, _ = dense(batch.column("__v"), dim)
        c, own = unit(raw)[0], np.flatnonzero(raw.any(axis=1))  # null, zero and other-sized vectors never enter a shortlist
        for s in range(0, len(own), _BATCH):
            rows = own[s:s + _BATCH]
            add_hamming(best, q_codes, _pack(raw[rows]), q, c[rows], at + rows)

    return scan(qids, len(q), shortlist, id_col, absorb, hamming=True)


def knn_quantized(queries: DataFrame, corpus: DataFrame, k: int = 10, oversample: int = 4, *,
                  query_id: str = "qid", query_vec: str = "vector", id_col: str = "id",
                  vec_col: str = "vector", decimals: int = 6,
                  max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, partitions: int | None = None) -> DataFrame:
    """V6: Hamming shortlist of ``k * oversample`` then exact cosine; ``(qid, id, hamming, score, rank)``."""
    shortlist = k * oversample
    q = columns(queries, query_id, query_vec, ("__qid", "__qv"))
    c = columns(corpus, id_col, vec_col, ("__id", "__v"))

    def merge(partial):
        w_short = Window.partitionBy("qid").orderBy(F.col("hamming").asc(), F.col(id_col).asc())
        short = partial.withColumn("__s", F.row_number().over(w_short)).filter(F.col("__s") <= shortlist)
        w = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), F.col(id_col).asc())
        return (short.filter(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(w))
                .filter(F.col("rank") <= k).select("qid", id_col, "hamming", F.round("score", decimals).alias("score"), "rank"))
    return search_blocks(q, c, 64 + 24 * shortlist, max_broadcast_bytes, id_col, lambda table, dim: _hamming_fn(table, dim, shortlist, id_col),
                         merge, partitions, hamming=True)
