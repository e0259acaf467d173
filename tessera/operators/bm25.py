"""BM25 search (V3) and its fusion with vector lists (V4).

The documents are tokenised once, in the JVM, and reduced to their lengths and the postings of
query terms; that table gives the statistics (N, average length, document frequencies) and is
what every query block scores.  A task adds each posting to the queries of its term only and
keeps a partial top-k per query; a per-query ``row_number`` merges them.  No (query, document)
pair table is ever materialised.

Scoring: ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``,
``tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))`` summed over the distinct query terms.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..session import cut_lineage, ship_package
from .bounded import DEFAULT_BROADCAST_BYTES, broadcast_if_small
from .search import RANK_DECIMALS, _keep_best, merge_blocks

K1, B = 1.2, 0.75


def query_postings(docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The documents tokenised once: ``(id, dl, postings array<struct<term, tf>>)`` with the
    postings of the given terms only, frozen by a reliable checkpoint.  Every document has a row
    (its null-term row keeps it), known by its own number: rows may share an id or have none.  The
    shuffle carries one row per document and query term in it."""
    # the token array is projected once: referenced twice inside a generator it would be re-evaluated
    exploded = (docs.select(F.col(id_col).alias("__id"), F.coalesce(tokens(text_col), F.array().cast("array<string>")).alias("__toks"),
                            F.monotonically_increasing_id().alias("__row"))
                .select("__row", "__id", F.size("__toks").alias("__dl"),
                        F.explode(F.concat(F.array(F.lit(None).cast("string")), "__toks")).alias("term")))
    wanted = broadcast_if_small(terms.select("term", F.lit(True).alias("__hit")), row_bytes=64)
    kept = exploded.join(wanted, "term", "left").filter(F.col("term").isNull() | F.col("__hit"))
    counted = kept.groupBy("__row", "term").agg(F.max("__id").alias("__id"), F.max("__dl").alias("__dl"), F.count(F.lit(1)).alias("tf"))
    # collect_list leaves the null of the null-term row out
    return cut_lineage(counted.groupBy("__row").agg(
        F.max("__id").alias("id"), F.max("__dl").alias("dl"),
        F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("postings")).drop("__row"))


def _score_fn(terms, starts, qidx, weights, qids, k, k1, b, avgdl, budget, kind):
    """mapInArrow body.  ``starts[j]:starts[j + 1]`` are the places of term j's queries in
    ``qidx`` and ``weights``: every posting adds to its own queries only."""
    nq = len(qids)
    block = max(1, min(4096, budget // max(1, nq * 8)))
    vocab = pa.array(terms, pa.string())

    def run(batches):
        best = None
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                part = whole.slice(at, block)
                n, lists = part.num_rows, part["postings"]
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                j = pc.fill_null(pc.index_in(flat.field("term"), value_set=vocab), -1).to_numpy(zero_copy_only=False)
                doc, tf = np.repeat(np.arange(n), sizes)[j >= 0], flat.field("tf").to_numpy(zero_copy_only=False)[j >= 0]
                j = j[j >= 0]
                if not len(j):
                    continue
                dl = part["dl"].to_numpy(zero_copy_only=False)
                norm = k1 * (1.0 - b + b * dl / avgdl) if avgdl > 0 else np.full(n, k1)
                sat = tf * (k1 + 1.0) / (tf + norm[doc])
                fan = starts[j + 1] - starts[j]
                row = np.repeat(np.arange(len(j)), fan)
                place = np.arange(len(row)) - np.repeat(np.cumsum(fan) - fan, fan) + starts[j][row]
                cell = doc[row] * nq + qidx[place]
                scores = np.round(np.bincount(cell, sat[row] * weights[place], n * nq).reshape(n, nq), RANK_DECIMALS)
                scores[np.bincount(cell, minlength=n * nq).reshape(n, nq) == 0] = -np.inf
                kk = min(k, n)
                kth = np.partition(scores, n - kk, axis=0)[n - kk, :]
                di, qi = np.nonzero((scores >= kth[None, :]) & np.isfinite(scores))
                ids = np.array(part["id"].to_pylist(), dtype=object)
                best = _keep_best(best, pd.DataFrame({"__qi": qi, "id": ids[di], "score": scores[di, qi]}), k, "id")
        if best is not None:
            yield pa.RecordBatch.from_pydict({"qid": pa.array([qids[i] for i in best["__qi"]]), "id": pa.array(best["id"].tolist(), kind),
                                              "score": best["score"].to_numpy()})

    return run


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "id",
                text_col: str = "text", query_id: str = "qid", query_text: str = "text",
                k1: float = K1, b: float = B, decimals: int = 6, stats_corpus: DataFrame | None = None,
                max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Top-k documents per query: ``(qid, id, score, rank)``; ties by id.  Queries are split
    into blocks whose postings fit ``max_broadcast_bytes``; every block reads the tokenised
    documents.  ``stats_corpus`` (same columns) supplies N, avgdl and df when ``docs`` is a
    filtered subset, so a filter restricts matches without changing scores."""
    spark = docs.sparkSession
    ship_package(spark)
    qterms = cut_lineage(queries.select(F.col(query_id).alias("qid"), F.explode(F.array_distinct(tokens(query_text))).alias("term")))
    vocab = qterms.select("term").distinct()
    posted = query_postings(docs, vocab, id_col, text_col)
    stats = posted if stats_corpus is None else query_postings(stats_corpus, vocab, id_col, text_col)
    total = stats.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("s")).first()
    n, avgdl = int(total["n"]), (float(total["s"]) / total["n"] if total["n"] else 0.0)
    df = cut_lineage(stats.select(F.explode("postings.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    nblocks = max(1, math.ceil(qterms.count() * 64 / max_broadcast_bytes))
    schema = T.StructType([T.StructField("qid", queries.schema[query_id].dataType), T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType())])
    parts = []
    for blk in range(nblocks):
        own = qterms if nblocks == 1 else qterms.filter(F.pmod(F.xxhash64("qid"), F.lit(nblocks)) == blk)
        rows = own.join(df, "term").select("term", "qid", "df").toPandas()
        rows = rows.sort_values("term", kind="stable")
        terms, starts = np.unique(rows["term"].to_numpy(dtype=str), return_index=True)
        starts = np.append(starts, len(rows))
        qidx, qids = pd.factorize(rows["qid"])
        weights = np.log(1.0 + (n - rows["df"].to_numpy(float) + 0.5) / (rows["df"].to_numpy(float) + 0.5))
        fn = _score_fn(list(terms), starts.astype(np.int64), qidx, weights, list(qids), k, k1, b, avgdl, 32 * 1024 * 1024, to_arrow_type(docs.schema[id_col].dataType))
        part = posted.select("id", "dl", "postings").mapInArrow(fn, schema)
        parts.append(part if nblocks == 1 else cut_lineage(part))
    return merge_blocks([p.withColumnRenamed("id", id_col) for p in parts], [F.col("score").desc(), F.col(id_col).asc()], k,
                        ["qid", id_col, "score"], decimals)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 10, c: int = 60, id_col: str = "id",
                           decimals: int = 6) -> DataFrame:
    """V4: fuse ranked lists ``(qid, id, rank)`` with ``sum 1 / (c + rank)``; ties by id."""
    u = None
    for i, l in enumerate(lists):
        part = l.select("qid", id_col, (F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("rrf"),
                        F.lit(i).alias("__src"))
        u = part if u is None else u.unionByName(part)
    fused = u.groupBy("qid", id_col).agg(F.round(F.sum("rrf"), RANK_DECIMALS).alias("score"),
                                         F.count(F.lit(1)).alias("lists"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(id_col).asc())
    return (fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("score", F.round("score", decimals)))


def weighted_fusion(lists: list[DataFrame], weights: list[float], k: int = 10, id_col: str = "id",
                    decimals: int = 6) -> DataFrame:
    """V4, weighted form: every list's scores ``(qid, id, score)`` are scaled to 0..1 per query
    (a list of equal scores counts as 1) and summed by weight; ties by id."""
    u = None
    for i, (l, weight) in enumerate(zip(lists, weights)):
        w = Window.partitionBy("qid")
        low, high = F.min("score").over(w), F.max("score").over(w)
        scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
        part = l.select("qid", id_col, (F.lit(float(weight)) * scaled).alias("__s"))
        u = part if u is None else u.unionByName(part)
    fused = u.groupBy("qid", id_col).agg(F.round(F.sum("__s"), RANK_DECIMALS).alias("score"), F.count(F.lit(1)).alias("lists"))
    by_score = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(id_col).asc())
    return (fused.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            .withColumn("score", F.round("score", decimals)))
