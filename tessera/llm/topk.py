"""Exact top-k search pruned by multi-resolution segment statistics.

Vectors are taken as whole numbers ``floor(scale * x)`` and compared by inner product; a higher
inner product is a smaller distance ``|q|^2 + |x|^2 - 2 q.x``.  For a segment of ``m``
components with means ``a, b`` and standard deviations ``s, t`` the inner product is at most
``m (a b + s t)``; summed over the segments this bounds the distance from below.  Each batch of
candidates is bounded at 1, 4 and 16 segments, coarse to fine, each level only for the pairs
that the one before left open, and the surviving pairs get their exact product.  What a pair is
compared with is the query's k-th best score so far in the task, so nothing in the top k is ever
pruned.  Queries go out in blocks of at most ``QUERY_BLOCK`` rows, one block at a time; each
task keeps k rows per query and the blocks' partial results are merged by a window.

Defined cases: rows with a null vector or a null, NaN or infinite component take no part, nor do
queries without an id; vectors of different lengths are not compared.  Of the candidates only
the query's own row is left out, that is one row of its id and vector: rows that repeat the id,
with whatever vector, and rows without an id take part.  Repeated candidate rows each take a
place, repeated query rows each get an answer; ties go to the smaller id, none last; a row that
repeats its query and whose product passes 64 bits has a null score; empty tables give an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise

QUERY_BLOCK = 2048
#: candidates bounded at once; the first lot is small, as it only finds first thresholds
LOT, FIRST_LOT = 4096, 128
RESOLUTIONS = (1, 4, 16)
_NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _segments(m: np.ndarray, n: int) -> np.ndarray:
    """Rows of scaled segment means and deviations, whose products sum to the bound."""
    parts = [p for p in np.array_split(m, n, axis=1) if p.shape[1]]
    scale = np.sqrt([p.shape[1] for p in parts])
    return np.hstack([np.column_stack([p.mean(axis=1) for p in parts]) * scale,
                      np.column_stack([p.std(axis=1) for p in parts]) * scale]) if parts else np.zeros((len(m), 0))


class Searcher:
    """The running top k of a block of queries of one vector length."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.numbers, self.ids, self.vectors, self.k = numbers, ids, vectors, k
        self.twins = np.zeros(len(ids), np.int64)  # rows of the query's id and vector
        self.stats = [_segments(vectors, n) for n in RESOLUTIONS]
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.best = tuple(np.zeros(0, np.int64) for _ in range(4))  # query, score, id, 1 without id
        self.least = np.full(len(ids), _NONE, np.int64)

    def _exact(self, q: np.ndarray, x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(len(q), np.int64)
        bound = vectors.shape[1] * np.abs(self.vectors).max(initial=0) * np.abs(vectors).max(initial=0)
        for at in range(0, len(q), 100_000):
            a, b = self.vectors[q[at:at + 100_000]], vectors[x[at:at + 100_000]]
            if bound < 2**53:  # every partial sum is a whole double
                out[at:at + len(a)] = np.einsum("ij,ij->i", a, b)
            else:
                out[at:at + len(a)] = [sum(int(u) * int(v) for u, v in zip(p, r)) for p, r in zip(a, b)]
        return out

    def _set_twins_apart(self, open_: np.ndarray, ids: np.ndarray, gaps: np.ndarray, vectors: np.ndarray) -> None:
        asked = np.flatnonzero(np.isin(ids, self.ids) & ~gaps)
        q, x = np.nonzero(ids[asked][None, :] == self.ids[:, None])
        x = asked[x]
        for at in range(0, len(q), 100_000):
            a, b = q[at:at + 100_000], x[at:at + 100_000]
            same = (self.vectors[a] == vectors[b]).all(axis=1)
            open_[a[same], b[same]] = False
            np.add.at(self.twins, a[same], 1)

    def twin_rows(self) -> tuple[np.ndarray, list[int | None]]:
        """Up to k + 1 rows a query, one of which is its own, and their scores."""
        q = np.repeat(np.arange(len(self.ids)), np.minimum(self.twins, self.k + 1))
        scores = [sum(int(u) ** 2 for u in self.vectors[i]) for i in q.tolist()]
        return q, [s if s < 2**63 else None for s in scores]

    def add(self, ids: np.ndarray, vectors: np.ndarray, gaps: np.ndarray | None = None) -> None:
        gaps = np.zeros(len(ids), bool) if gaps is None else gaps
        slack = 1e-9 * np.outer(self.norms, np.sqrt((vectors**2).sum(axis=1))) + 1e-3
        open_ = np.ones((len(self.ids), len(ids)), bool)
        self._set_twins_apart(open_, ids, gaps, vectors)
        floor = self.least.astype(float)
        for stats, n in zip(self.stats, RESOLUTIONS):
            rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(rows) or not len(cols):
                return
            part = np.ix_(rows, cols)
            open_[part] &= stats[rows] @ _segments(vectors[cols], n).T + slack[part] >= floor[rows, None]
        q, x = np.nonzero(open_)
        score = self._exact(q, x, vectors)
        stay = score >= self.least[q]
        found = [np.concatenate(p) for p in zip(self.best, (q[stay], score[stay], ids[x[stay]], gaps[x[stay]].astype(np.int64)))]
        q, score, who, gap = found
        order = np.lexsort((who, gap, -score, q))
        q, score = q[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.best = tuple(v[order][rank < self.k] for v in found)
        last = rank == self.k - 1
        self.least[q[last]] = score[last]


def _batches(rows, scale: float):
    """(ids, 0 for none, whole-number vectors as doubles, places) per vector length."""
    flat, ids = rows["vector"], pc.fill_null(rows["id"], 0).to_numpy(zero_copy_only=False)
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    length = flat.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(length)])
    values = np.floor(scale * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield ids[at], values[offsets[at][:, None] + np.arange(d)[None, :]], at


def _search_block(corpus: DataFrame, block, scale: float, k: int) -> DataFrame:
    numbers = block["number"].to_numpy()
    parts = [(numbers[at], ids, vectors) for ids, vectors, at in _batches(block, scale)]
    shared = corpus.sparkSession.sparkContext.broadcast(parts)  # at most QUERY_BLOCK vectors

    def run(batches):
        found = {vectors.shape[1]: Searcher(n, ids, vectors, k) for n, ids, vectors in shared.value}
        fresh = set(found)
        for b in batches:
            without = pc.is_null(b["id"]).to_numpy(zero_copy_only=False)
            for ids, vectors, at in _batches(b, scale):
                if (own := found.get(vectors.shape[1])) is None:
                    continue
                lot, gaps = 0, without[at]
                while lot < len(ids):
                    size = FIRST_LOT if vectors.shape[1] in fresh else LOT
                    fresh.discard(vectors.shape[1])
                    own.add(ids[lot:lot + size], vectors[lot:lot + size], gaps[lot:lot + size])
                    lot += size
        for own in found.values():
            q, score, who, gap = own.best
            yield pa.RecordBatch.from_pydict({"number": own.numbers[q], "query_id": own.ids[q], "id": pa.array(who, mask=gap > 0),
                                              "score": score, "twin": pa.array(np.zeros(len(q), np.int32))})
            q, scores = own.twin_rows()
            yield pa.RecordBatch.from_pydict({"number": own.numbers[q], "query_id": own.ids[q], "id": own.ids[q],
                                              "score": pa.array(scores, pa.int64()), "twin": pa.array(np.ones(len(q), np.int32))})

    return corpus.mapInArrow(run, "number bigint, query_id bigint, id bigint, score bigint, twin int")


def exact_top_k(queries: DataFrame, corpus: DataFrame, k: int, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score) for tables of (id bigint, vector array); the queries are rows
    of the corpus."""
    spark = corpus.sparkSession
    ship_package(spark)
    narrow = [df.where(usable(F.col("vector")))
              .select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
              for df in (queries, corpus)]
    asked = materialise(narrow[0].where("id is not null").withColumn("number", F.monotonically_increasing_id()), "topk-queries")
    ranges, size = [], 0
    for r in asked.groupBy((F.expr(f"number div {QUERY_BLOCK}")).alias("b")).agg(
            F.min("number").alias("lo"), F.max("number").alias("hi"), F.count("*").alias("n")).orderBy("b").collect():
        if ranges and size + r["n"] <= QUERY_BLOCK:
            ranges[-1][1], size = r["hi"], size + r["n"]
        else:
            ranges.append([r["lo"], r["hi"]])
            size = r["n"]
    by_score = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"), "twin")
    up_to = by_score.rowsBetween(Window.unboundedPreceding, 0)
    results = []
    for lo, hi in ranges:
        block = asked.where(F.col("number").between(lo, hi)).toArrow()
        # of the first k + 1 one may be the query's own row: it goes and those behind it move up
        first = (_search_block(narrow[1], block, scale, k).withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
                 .withColumn("twins", F.sum("twin").over(up_to)).where("not (twin = 1 and twins = 1)")
                 .withColumn("rank", (F.col("place") - F.when(F.col("twins") > 0, 1).otherwise(0)).cast("int")))
        results.append(materialise(first.where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), "topk-block"))
    out = spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint") if not results else results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
