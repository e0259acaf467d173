import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.embed import HashEmbedder, embed, hash_embed_cells, hash_embedder_factory
from tessera.sinks.bulk import CountMismatch, attach_vectors, write_bulk_ndjson
from tessera.sinks.store import create_store, write_batch, write_vectors_iter
from tessera.sources.bulk import bulk_import_summary, read_bulk_ndjson
from tessera.sources.store import read_ids, read_vectors, store_info


def _vecs(spark, n, dim, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)).astype(np.float32)
    return spark.createDataFrame([(f"doc_{i}", m[i].tolist(), i) for i in range(n)],
                                 "id string, vector array<float>, k long"), m


def test_store_two_halves_and_slice(spark, tmpdir_path):
    root = tmpdir_path + "/store"
    df, m = _vecs(spark, 100, 16)
    create_store(spark, root, 100, 16, metadata={"model_name": "m"}, chunk_size=10)
    write_batch(spark, root, df.filter(F.col("k") < 50), 0, order_by="k")
    write_batch(spark, root, df.filter(F.col("k") >= 50), 50, order_by="k")
    got = np.array([r["vector"] for r in read_vectors(spark, root, 0, 10).collect()], dtype=np.float32)
    assert np.array_equal(got, m[:10])
    assert [r["id"] for r in read_ids(spark, root, 95).collect()] == [f"doc_{i}" for i in range(95, 100)]
    # overwrite positions 10..19 with zeros -> new version, rest unchanged
    z = spark.createDataFrame([(f"z{i}", [0.0] * 16, i) for i in range(10)], "id string, vector array<float>, k long")
    v = write_batch(spark, root, z, 10, order_by="k")
    assert v == 2
    ids = [r["id"] for r in read_ids(spark, root).collect()]
    assert ids[:10] == [f"doc_{i}" for i in range(10)] and ids[10:20] == [f"z{i}" for i in range(10)]
    info = store_info(spark, root).first()
    assert info["stored_vectors"] == 100 and info["vector_dim"] == 16 and info["size_mb"] > 0


def test_write_vectors_iter_stops_at_shorter(spark, tmpdir_path):
    root = tmpdir_path + "/s2"
    create_store(spark, root, None, 4)
    vec = spark.createDataFrame([(i, [float(i)] * 4) for i in range(10)], "pos long, vector array<float>")
    ids = spark.createDataFrame([(i, f"id{i}") for i in range(7)], "pos long, id string")
    write_vectors_iter(spark, root, vec, ids)
    assert read_ids(spark, root).count() == 7


def test_hash_embedder_sql_and_numpy_agree(spark):
    texts = ["Hello world hello", "", "Ünïcödé text 42", "a a a b b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    cells = {(r["id"], r["bucket"]): r["value"] for r in hash_embed_cells(df, 16).collect()}
    m = HashEmbedder(16)(texts)
    for i in range(len(texts)):
        for b in range(16):
            assert abs(cells.get((i, b), 0.0) - m[i, b]) < 1e-12
    v = embed(df, hash_embedder_factory(16), dim=16).collect()
    assert all(r["ok"] for r in v)


def test_embed_failure_policies(spark):
    df = spark.createDataFrame([(i, "t") for i in range(5)], "id long, text string")

    def bad_factory():
        def fn(texts):
            raise RuntimeError("model down")
        return fn

    out = embed(df, bad_factory, dim=4, on_error="null").collect()
    assert all(r["vector"] is None and r["ok"] is False for r in out)
    with pytest.raises(Exception):
        embed(df, bad_factory, dim=4, on_error="fail").collect()


def test_bulk_roundtrip_and_odd_line(spark, tmpdir_path):
    docs = spark.createDataFrame([(f"d{i}", f"text {i} é\nnext", "f.pdf", i) for i in range(20)],
                                 "id string, text string, source_file string, chunk_id int")
    vecs = spark.createDataFrame([(f"d{i}", [float(i), 0.5]) for i in range(20)], "id string, vector array<float>")
    j = attach_vectors(docs, vecs)
    path = write_bulk_ndjson(j, tmpdir_path + "/bulk", "idx", order_by="chunk_id")
    # a blank line and a dangling action line are tolerated
    with open(tmpdir_path + "/bulk/extra.txt", "w") as f:
        f.write('\n{"index":{"_index":"idx","_id":"zz"}}\n')
    back = read_bulk_ndjson(spark, path, "text string, vector array<double>, source_file string, chunk_id int")
    rows = sorted(back.collect(), key=lambda r: r["doc"]["chunk_id"])
    assert len(rows) == 20
    assert rows[3]["_id"] == "d3" and rows[3]["doc"]["text"] == "text 3 é\nnext"
    assert rows[3]["doc"]["vector"] == [3.0, 0.5]
    summ = {r["batch_no"]: (r["indexed"], r["errors"]) for r in
            bulk_import_summary(back.select("pos", F.lit(None).cast("string").alias("error")), 8).collect()}
    assert summ[None] == (20, 0) and summ[0] == (8, 0) and summ[2] == (4, 0)
    with pytest.raises(CountMismatch):
        attach_vectors(docs, vecs.limit(5))
