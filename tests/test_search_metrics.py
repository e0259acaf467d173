import numpy as np
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.ann import knn_ivf
from tessera.operators.bm25 import bm25_search
from tessera.operators.metrics import latency_summary, tune_batch_size
from tessera.operators.quantize import binary_codes, knn_quantized

SF01 = "/root/testdata/sf0.01"


def _emb(spark):
    return spark.read.parquet(f"{SF01}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _brute(m, ids, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i in range(len(ids)):
        order = np.lexsort((ids, -s[i]))[:k]
        out[ids[i]] = [int(ids[j]) for j in order]
    return out


def test_knn_exact_matches_numpy_and_blocks(spark):
    v = _emb(spark)
    pdf = v.toPandas()
    m = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    ids = pdf["id"].to_numpy()
    ref = _brute(m, ids, 5)
    q = v.select(F.col("id").alias("qid"), "vector")
    for limit in (64 * 1024 * 1024, 20_000):  # one block, then many query blocks
        got = {}
        for r in search.knn_exact(q, v, 5, max_broadcast_bytes=limit).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
        assert {k: [i for _, i in sorted(x)] for k, x in got.items()} == ref


def test_quantized_and_ivf_recall_floor(spark):
    v = _emb(spark)
    q = v.select(F.col("id").alias("qid"), "vector")
    exact = search.knn_exact(q, v, 10)
    rq = search.mean_recall(search.recall_at_k(knn_quantized(q, v, 10, 8), exact, 10)).first()["mean_recall"]
    ri = search.mean_recall(search.recall_at_k(knn_ivf(q, v, 10, cells=8, nprobe=4), exact, 10)).first()["mean_recall"]
    assert rq >= 0.5 and ri >= 0.5


def test_binary_codes_bits(spark):
    df = spark.createDataFrame([([1.0, -1.0, 2.0] + [0.0] * 61 + [3.0],)], "v array<double>")
    c = df.select(binary_codes("v", 65).alias("c")).first()["c"]
    assert c == [1 | 4, 1]


def test_bm25_matches_python(spark):
    import math
    import re
    docs = ["the cat sat", "the dog sat down", "cats and dogs", "", "the the the cat"]
    qs = ["cat sat", "dog", "the"]
    d = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    q = spark.createDataFrame(list(enumerate(qs)), "qid long, text string")
    got = {(r["qid"], r["id"]): r["score"] for r in bm25_search(d, q, 10).collect()}
    toks = [[t for t in re.split(r"[^\w]+", x.lower()) if t] for x in docs]
    n, avgdl = len(docs), sum(map(len, toks)) / len(docs)
    for qi, qt in enumerate(qs):
        terms = set(qt.split())
        for di, dt in enumerate(toks):
            s = 0.0
            for t in terms:
                tf = dt.count(t)
                if tf:
                    df = sum(1 for x in toks if t in x)
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    s += idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(dt) / avgdl))
            if s:
                assert abs(got[(qi, di)] - s) < 1e-6


def test_tune_batch_ladder(spark):
    thr = spark.createDataFrame([("m", 64, 100.0, 3), ("m", 128, 180.0, 3), ("m", 256, 170.0, 3),
                                 ("m", 512, 120.0, 3), ("m", 1024, 900.0, 3), ("n", 64, None, 0)],
                                "model string, batch_size int, throughput double, calls_ok long")
    got = {r["model"]: (r["optimal_batch_size"], r["optimal_throughput"]) for r in tune_batch_size(thr).collect()}
    assert got == {"m": (128, 180.0), "n": (64, 0.0)}


def test_latency_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random(1000)
    df = spark.createDataFrame([("a", float(v), True) for v in x], "model string, latency_s double, ok boolean")
    r = latency_summary(df, ["model"]).first()
    ms = x * 1000
    assert abs(r["p99_ms"] - np.percentile(ms, 99)) < 1e-5
    assert abs(r["std_ms"] - ms.std()) < 1e-5


def test_lsh_candidates_are_close(spark):
    from tessera.operators.ann import knn_lsh
    v = _emb(spark)
    q = v.select(F.col("id").alias("qid"), "vector")
    rows = knn_lsh(q, v, 3, threshold=0.5, bucket_length=0.5).collect()
    assert rows and all(r["score"] > 1 - 0.5**2 / 2 - 1e-6 and r["rank"] <= 3 for r in rows)
    assert {(r["qid"], r["id"]) for r in rows if r["rank"] == 1} and all(r["qid"] == r["id"] for r in rows if r["score"] > 0.999999)


def test_units_and_wide_resources(spark):
    from tessera.functions.units import bytes_to_mb, percent, seconds_to_hours, seconds_to_minutes, seconds_to_ms
    from tessera.operators.telemetry import resource_summary, resource_wide
    r = spark.createDataFrame([(7200.0, 3 * 1048576, 25.0, 0.0)], "s double, b long, u double, z double").select(
        seconds_to_minutes("s"), seconds_to_hours("s"), seconds_to_ms("s"), bytes_to_mb("b"),
        percent("u", F.lit(50.0)), percent("u", "z")).first()
    assert tuple(r) == (120.0, 2.0, 7200000.0, 3.0, 50.0, None)
    m = spark.createDataFrame([("es", "cpu", 1.0), ("es", "cpu", 3.0), ("es", "mem", 5.0), ("mv", "cpu", 2.0)],
                              "system string, metric string, value double")
    wide = {r["system"]: (r["cpu"], r["mem"]) for r in resource_wide(resource_summary(m), ["cpu", "mem"]).collect()}
    assert wide == {"es": (2.0, 5.0), "mv": (2.0, None)}


def test_utf8_check_flags_bad_file(spark, tmpdir_path):
    from tessera.sources.corpus import utf8_check_files
    with open(tmpdir_path + "/good.tsv", "wb") as f:
        f.write("1\tgood 中文\n".encode())
    with open(tmpdir_path + "/bad.tsv", "wb") as f:
        f.write(b"1\tbad \xff\xfe bytes\n")
    got = {r["path"].rsplit("/", 1)[-1]: r["valid_utf8"] for r in utf8_check_files(spark, tmpdir_path, "*.tsv").collect()}
    assert got == {"good.tsv": True, "bad.tsv": False}


def test_quantized_and_ivf_query_blocks_agree(spark):
    v = _emb(spark)
    q = v.select(F.col("id").alias("qid"), "vector")
    a = sorted(map(tuple, knn_quantized(q, v, 5).collect()))
    b = sorted(map(tuple, knn_quantized(q, v, 5, max_broadcast_bytes=30_000).collect()))
    assert a == b
    from tessera.operators.ann import train_cells
    cent = train_cells(v, 8)
    c = sorted(map(tuple, knn_ivf(q, v, 5, nprobe=3, centroids=cent).collect()))
    d = sorted(map(tuple, knn_ivf(q, v, 5, nprobe=3, centroids=cent, max_broadcast_bytes=30_000).collect()))
    assert c == d


def test_latency_approx_switch(spark):
    rng = np.random.default_rng(2)
    x = rng.random(5000)
    df = spark.createDataFrame([("a", float(v), True) for v in x], "model string, latency_s double, ok boolean")
    r = latency_summary(df, ["model"], approx=True).first()
    assert abs(r["p50_ms"] - np.percentile(x * 1000, 50)) < 5.0
