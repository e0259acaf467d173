"""Block scans of the searches against brute force, with copies, gaps and small blocks."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.ann import knn_ivf, knn_lsh
from tessera.operators.quantize import knn_quantized

RNG = np.random.default_rng(7)
BASE = RNG.standard_normal((90, 8)).round(3).tolist()
# copies of one vector, a zero vector, a missing one and one of another length
ROWS = [(i, BASE[i % 90 if i % 4 else 0], i % 3) for i in range(150)] + [(150, [0.0] * 8, 1), (151, None, 1), (152, [1.0], 1), (153, BASE[5], None)]
GOOD = [r for r in ROWS if r[1] and len(r[1]) == 8 and any(r[1])]


def _frame(spark):
    return spark.createDataFrame(ROWS, "id long, vector array<double>, label int").repartition(5)


def _queries(v):
    return v.select(F.col("id").alias("qid"), "vector", "label")


def _cos(a, b):
    a, b = np.array(a), np.array(b)
    return round(float((a / np.linalg.norm(a)) @ (b / np.linalg.norm(b))), 12)


def _top(pairs, k):
    return {(q, c, r) for q in {p[0] for p in pairs} for r, (_, c) in enumerate(sorted((-s, c) for x, c, s in pairs if x == q)[:k], 1)}


def _got(df):
    return {(r["qid"], r["id"], r["rank"]) for r in df.collect()}


def test_exact_in_blocks_and_tasks(spark):
    v = _frame(spark)
    want = _top([(q, c, _cos(a, b)) for q, a, _ in GOOD for c, b, _ in GOOD], 4)
    for limits in ({}, {"partitions": 3, "max_broadcast_bytes": 15_000}):
        assert _got(search.knn_exact(_queries(v), v, 4, **limits)) == want
    want = _top([(q, c, _cos(a, b)) for q, a, x in GOOD for c, b, y in GOOD if x == y and x is not None], 4)
    assert _got(search.knn_partitioned(_queries(v), v, "label", 4, partitions=3)) == want


def test_quantized_in_tasks(spark):
    v = _frame(spark)
    code = {i: sum(1 << n for n, x in enumerate(a) if x > 0) for i, a, _ in GOOD}
    short = [(q, c) for q in code for _, c in sorted(((code[q] ^ code[c]).bit_count(), c) for c in code)[:12]]
    vec = {i: a for i, a, _ in GOOD}
    want = _top([(q, c, _cos(vec[q], vec[c])) for q, c in short], 4)
    assert _got(knn_quantized(_queries(v), v, 4, 3, partitions=3)) == want


def test_cells_in_tasks(spark):
    v, cent = _frame(spark), search._unit(np.array(BASE[:6]))[0]
    near = {i: np.argsort(-(cent @ (np.array(a) / np.linalg.norm(a))), kind="stable") for i, a, _ in GOOD}
    want = _top([(q, c, _cos(a, b)) for q, a, _ in GOOD for c, b, _ in GOOD if near[c][0] in near[q][:2]], 4)
    assert _got(knn_ivf(_queries(v), v, 4, nprobe=2, centroids=cent, partitions=3)) == want


def test_lsh_makes_no_pair_rows(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    v = _frame(spark).where("vector is null or size(vector) = 8")  # the hashes need one length
    found = knn_lsh(_queries(v), v, 4, threshold=1.1, bucket_length=0.5, tables=3, seed=3, partitions=3)
    assert "Join" not in found._jdf.queryExecution().toString()
    unit = spark.createDataFrame([(i, (np.array(a) / np.linalg.norm(a)).tolist()) for i, a, _ in GOOD], "id long, u array<double>")
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.5, numHashTables=3, seed=3)
    rows = unit.select("id", array_to_vector("u").alias("f"))
    h = {r["id"]: [x[0] for x in r["h"]] for r in model.fit(rows).transform(rows).collect()}
    pairs = [(q, c, _cos(a, b)) for q, a, _ in GOOD for c, b, _ in GOOD if any(x == y for x, y in zip(h[q], h[c]))]
    assert _got(found) == _top([p for p in pairs if p[2] > 1 - 1.1**2 / 2], 4)


def test_recall_reads_the_exact_side_once(spark):
    v = _frame(spark)
    exact = search.knn_exact(_queries(v), v, 4)
    plan = search.recall_at_k(exact.where("id % 2 = 0"), exact, 4)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    halves = {r["qid"]: r["recall"] for r in plan.collect()}
    assert halves == {q: sum(c % 2 == 0 for x, c, _ in _got(exact) if x == q) / 4 for q in halves} and len(halves) == len(GOOD)
