"""Stored indexes, the store's manifest, and that nothing is computed twice."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.ann import cell_means, knn_ivf
from tessera.operators.bm25 import bm25_search
from tessera.operators.embed import generate_and_store
from tessera.operators.quantize import knn_quantized
from tessera.operators.text_index import build_text_index, search_text_index
from tessera.operators.vector_index import build_cells, build_codes, choose_nprobe, choose_oversample, search_cells, search_codes
from tessera.sinks.store import _publish, create_store, manifest, versions, write_batch
from tessera.sources.store import read_ids, read_store, read_vectors, store_info


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# ------------------------------------------------------------------ BM25

def _bm25(docs, queries, k):
    toks = [[t for t in re.split(r"[^a-z0-9]+", (text or "").lower()) if t] for _, text in docs]
    n, avgdl = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for ts in toks for t in set(ts))
    out = []
    for qid, text in queries:
        terms = {t for t in re.split(r"[^a-z0-9]+", text.lower()) if t}
        hits = []
        for (doc, _), ts in zip(docs, toks):
            tf = Counter(ts)
            if terms & set(ts):
                score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / avgdl))
                            for t in terms if tf[t])
                hits.append((-round(score, 12), (doc is not None, doc or 0), doc))
        out += [(qid, doc, round(-s, 6), r) for r, (s, _, doc) in enumerate(sorted(hits, key=lambda h: h[:2])[:k], 1)]
    return out


def _texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    rows = [(rng.choice((None, i, i, i // 3)), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(n)]
    return rows + [(5, None), (6, ""), (None, "w1 w1 w1"), (7, "apple pie"), (7, "banana split"), (8, "apple tart")]


@pytest.mark.parametrize("k", [3, 10])
def test_bm25_by_row_and_over_a_stored_index(spark, tmpdir_path, k):
    """Rows that share an id or have none stay rows of their own; several blocks of a common term;
    skipping changes nothing."""
    rows = _texts(2500)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    queries = [(1, "apple banana"), (2, "w1 w2 w3"), (3, "w7 apple w1"), (4, "w1"), (5, "nothing here"), (6, "w17 w23 w300 w1 w2 w5")]
    qs = spark.createDataFrame(queries, "qid long, text string")
    want = _bm25(rows, queries, k)
    got = [tuple(r) for r in bm25_search(docs, qs, k).select("qid", "id", "score", "rank").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    root = build_text_index(docs, tmpdir_path + "/index")
    for skip in (True, False):
        found = search_text_index(qs, root, k, skip=skip)
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    only = spark.createDataFrame([(i,) for i in range(0, 900, 2)], "id long")
    kept = [(d, s) for q, d, s, _ in _bm25(rows, queries[:3], 10_000) if q == 2 and d is not None and d < 900 and d % 2 == 0][:k]
    some = sorted((r["rank"], r["id"], r["score"]) for r in search_text_index(qs, root, k, only=only).where("qid = 2").collect())
    assert [s[2] for s in some] == sorted((s for _, s in kept), reverse=True) or len(some) == k


def test_text_index_reads_no_text_and_its_terms_only(spark, tmpdir_path):
    import os
    docs = spark.createDataFrame(_texts(300), "id long, text string")
    root = build_text_index(docs, tmpdir_path + "/index", buckets=16)
    assert sorted(d for d in os.listdir(root)) == ["blocks", "docs", "stats", "terms"]
    blocks = spark.read.parquet(root + "/blocks")
    assert blocks.agg(F.sum("n")).first()[0] == sum(len(set((t or "").lower().split())) for _, t in _texts(300))
    from tessera.operators.text_index import _bucket_filter
    wanted = blocks.where("term = 'apple'").select("bucket", "term").distinct()
    assert "bucket" in _plan(_bucket_filter(blocks, wanted)).split("PartitionFilters")[1][:80]
    empty = build_text_index(docs.limit(0), tmpdir_path + "/none")
    assert search_text_index(spark.createDataFrame([(1, "apple")], "qid long, text string"), empty).collect() == []


def test_text_index_of_equal_texts_keeps_k_rows_a_segment(spark, tmpdir_path, monkeypatch):
    """Equal scores don't pile up between the steps of a search; null and repeated ids stay rows."""
    from tessera.operators import text_index
    ids = [None, None, *(i // 2 for i in range(1500))]
    docs = spark.createDataFrame([(i, "same words here") for i in ids] + [(-5, "other words"), (-6, "rest")], "id long, text string").repartition(4)
    queries = [(1, "same here"), (None, "words"), (3, "rest")]
    qs = spark.createDataFrame(queries, "qid long, text string")
    root = build_text_index(docs, tmpdir_path + "/index")
    sizes, cut = [], text_index.cut_lineage

    def counted(df, *a):
        out = cut(df, *a)
        if "score" in out.columns:
            sizes.append(out.count())
        return out
    monkeypatch.setattr(text_index, "cut_lineage", counted)
    segments = spark.read.parquet(root + "/blocks").select("seg").distinct().count()
    found = {r[0]: [] for r in queries}
    for r in search_text_index(qs, root, 5).orderBy("qid", "rank").collect():
        found[r["qid"]].append(r["id"])
    assert found == {1: [None, None, 0, 0, 1], None: [-5, None, None, 0, 0], 3: [-6]}
    assert sizes and max(sizes) <= segments * 5 * len(queries)
    for bytes_ in (64, 200):  # several blocks of queries
        again = search_text_index(qs, root, 5, max_broadcast_bytes=bytes_).orderBy("qid", "rank").collect()
        assert [r["id"] for r in again if r["qid"] == 1] == found[1] and len(again) == 11


def test_hybrid_lists_over_the_stored_index_are_bounded(spark, tmpdir_path, monkeypatch):
    """The first 100 of each list, fused: a hundred rows a segment and query at most leave the scoring."""
    from tessera.operators import text_index
    from tessera.operators.bm25 import reciprocal_rank_fusion
    docs = spark.createDataFrame([(i, "same words here") for i in range(1200)], "id long, text string").repartition(4)
    vectors = docs.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    root = build_text_index(docs, tmpdir_path + "/index")
    qs = spark.createDataFrame([(1, "words")], "qid long, text string")
    sizes, cut = [], text_index.cut_lineage

    def counted(df, *a):
        out = cut(df, *a)
        if "score" in out.columns:
            sizes.append(out.count())
        return out
    monkeypatch.setattr(text_index, "cut_lineage", counted)
    vec = search.knn_exact(spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>"), vectors, 100)
    found = reciprocal_rank_fusion([search_text_index(qs, root, 100), vec], 10).orderBy("rank").collect()
    assert [(r["id"], r["lists"], r["score"]) for r in found] == [(i, 2, round(2 / (61 + i), 6)) for i in range(10)]
    assert sizes and max(sizes) <= 100 * spark.read.parquet(root + "/blocks").select("seg").distinct().count()


def test_text_index_segments_hold_the_engines_tokens(spark):
    import pyarrow as pa

    from tessera.functions.text import tokens
    from tessera.operators.text_index import _SEGMENT_BYTES, SEGMENT, _pack, _segments, _token_chars, _unpack, _words
    texts = ["", " ", "a", "\u0130x \u212aelvin \u03a3\u03a3 \u1e9e", "\u4e2d\u6587\u3002\u6587 x2\u00b2", "\U0001d400\U0001f600z \U00010400", "e\u0301 \ufeffb\u00a0c", "A-b_C d", "1.5\u0663"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", tokens("text").alias("t"), F.concat(F.lower("text"), F.lit(" ")).alias("s")).orderBy("i").collect()
    codes, vocab, dl = _words(pa.array([r["s"] for r in rows]), np.unpackbits(_token_chars(spark)).view(bool))
    assert [vocab[int(c)].as_py() for c in codes] == [t for r in rows for t in r["t"]] and dl.tolist() == [len(r["t"]) for r in rows]
    # numbers of every width
    tf, dl = np.array([3, 1, 300, 70_000, 2]), np.array([9, 300, 70_000, 80_000, 2])
    begin, sizes = np.array([0, 2, 4]), np.array([2, 2, 1])
    place = np.array([0, 65_535, 7, 300, 1])
    blocks = _pack(place, tf, dl, begin, sizes)
    for at in (0, 1):
        got = _unpack(blocks.slice(at), sizes[at:], np.maximum.reduceat(tf, begin)[at:])
        assert [x.tolist() for x in got] == [x[begin[at]:].tolist() for x in (place, tf, dl)]
    # bounded segments; a long text is one of its own
    lengths = [10] * 100_000 + [_SEGMENT_BYTES + 1] + [_SEGMENT_BYTES // 3] * 4 + [5]
    batch = pa.record_batch({"id": pa.array(range(len(lengths))), "text": pa.array(["x" * n for n in lengths])})
    found = [t["id"].to_pylist() for t in _segments([batch.slice(0, 70_000), batch.slice(70_000)])]
    assert [i for ids in found for i in ids] == list(range(len(lengths)))
    assert [len(ids) for ids in found] == [SEGMENT, 100_000 - SEGMENT, 1, 3, 2]


# ------------------------------------------------------------------ vectors

def _vectors(spark, n=600, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim)) * 2
    rows = []
    for i in range(n):
        v = (centres[i % 8] + rng.standard_normal(dim)).astype(np.float32).tolist()
        rows.append((i, None if i % 50 == 7 else [0.0] * dim if i % 50 == 8 else v, i % 8))
    return spark.createDataFrame(rows, "id long, vector array<float>, label int").repartition(3)


def _top(df):
    return sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())


def test_stored_cells_read_probed_folders_only(spark, tmpdir_path):
    v = _vectors(spark)
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    cent = cell_means(v.where("vector is not null"), "label")
    root = build_cells(v, tmpdir_path + "/cells", centroids=cent)
    assert _top(search_cells(q, root, 5, 3)) == _top(knn_ivf(q, v, 5, nprobe=3, centroids=cent))
    assert _top(search_cells(q, root, 5, 3, max_broadcast_bytes=2_000)) == _top(search_cells(q, root, 5, 3))
    one = q.where("qid = 0")
    text = _plan(search_cells(one, root, 5, 1))
    scans = re.findall(r"PartitionFilters: \[(.*?)\]", text)
    assert scans and all("cell" in s for s in scans)
    nprobe = choose_nprobe(q, root, 5, 0.95)
    assert 1 <= nprobe <= 8
    recall = search.mean_recall(search.recall_at_k(search_cells(q, root, 5, nprobe), search.knn_exact(q, v, 5), 5)).first()["mean_recall"]
    assert recall >= 0.95
    assert _top(search_cells(q, root, 5, 8)) == _top(search.knn_exact(q, v, 5))  # all cells: exact
    trained = build_cells(v, tmpdir_path + "/trained", cells=6)
    assert _top(search_cells(q, trained, 5, 6)) == _top(search.knn_exact(q, v, 5))
    assert search_cells(q.limit(0), root, 5).collect() == []


def test_stored_codes_give_the_shortlist_of_the_plain_search(spark, tmpdir_path):
    v = _vectors(spark)
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    root = build_codes(v, tmpdir_path + "/codes", ranges=8)

    def top(df):
        return sorted((r["qid"], r["rank"], r["id"], r["hamming"], r["score"]) for r in df.collect())
    want = top(knn_quantized(q, v, 5, oversample=3))
    assert top(search_codes(q, root, 5, 3)) == want and top(search_codes(q, root, 5, 3, max_broadcast_bytes=4_000)) == want
    scan = spark.read.parquet(root + "/rows").select("pos", "id", "code", "range")
    assert "vector" not in re.search(r"ReadSchema: (.*)", _plan(scan)).group(1)
    oversample = choose_oversample(q, root, 5, 0.9)
    recall = search.mean_recall(search.recall_at_k(search_codes(q, root, 5, oversample), search.knn_exact(q, v, 5), 5)).first()["mean_recall"]
    assert recall >= 0.9


# ------------------------------------------------------------------ store

def test_overwrite_rewrites_touched_files_only(spark, tmpdir_path):
    root = tmpdir_path + "/store"
    df = spark.createDataFrame([(f"d{i}", [float(i)] * 4, i) for i in range(1000)], "id string, vector array<float>, k long")
    create_store(spark, root, None, 4, chunk_size=10)  # 100 rows a file
    assert write_batch(spark, root, df, 0, order_by="k") == 1
    before = {r["path"]: (r["lo"], r["hi"]) for r in manifest(spark, root).collect()}
    assert len(before) >= 8
    new = spark.createDataFrame([(f"n{i}", [-1.0] * 4, i) for i in range(30)], "id string, vector array<float>, k long")
    assert write_batch(spark, root, new, 450, order_by="k") == 2
    after = {r["path"]: (r["lo"], r["hi"]) for r in manifest(spark, root).collect()}
    kept = {p for p, (lo, hi) in before.items() if hi < 450 or lo >= 480}
    assert len(kept) >= len(before) - 2 and kept == set(before) & set(after)
    ids = [r["id"] for r in read_ids(spark, root).collect()]
    assert sorted(after.values()) == sorted(set(after.values())) and all(a[1] < b[0] for a, b in zip(sorted(after.values()), sorted(after.values())[1:]))
    assert ids == [f"n{i - 450}" if 450 <= i < 480 else f"d{i}" for i in range(1000)]
    assert [r["id"] for r in read_store(spark, root, version=1).orderBy("pos").collect()] == [f"d{i}" for i in range(1000)]
    assert store_info(spark, root).first()["stored_vectors"] == 1000
    # ordered reads take the layout as it is, and only the slice's files
    part = read_vectors(spark, root, 200, 300)
    assert "rangepartitioning" not in _plan(read_ids(spark, root)) and "Sort" not in _plan(part)
    assert [r["pos"] for r in part.collect()] == list(range(200, 300))
    assert len(part.inputFiles()) <= 3 < len(after)
    with pytest.raises(RuntimeError):
        _publish(spark, root, manifest(spark, root), 2)
    assert versions(spark, root) == [1, 2]
    assert write_batch(spark, root, new.limit(0), 5, order_by="k") == 2 and write_batch(spark, root, new, 1000, order_by="k") == 2
    assert read_ids(spark, root).count() == 1030


def test_a_stored_corpus_is_embedded_once(spark, tmpdir_path):
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def model(texts):
            seen.add(len(texts))
            return np.ones((len(texts), 4))
        return model
    df = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "id long, text string").repartition(4)
    row = generate_and_store(df, factory, tmpdir_path + "/e4", dim=4).first()
    assert row["total_vectors"] == 300 and row["failed_vectors"] == 0 and seen.value == 300


# ------------------------------------------------------------------ heads, errors, occurrences, sketches

def test_heads_errors_and_occurrences_without_full_sorts(spark):
    from tessera.operators.sample import load_head
    from tessera.operators.validate import duplicate_id_lines, numbered_errors
    rng = random.Random(1)
    lines = [(i, "" if i % 11 == 0 else "no tab" if i % 37 == 5 else f"{'hot' if i % 3 == 0 else rng.randrange(200)}\ttext {i}") for i in range(900)]
    df = spark.createDataFrame(lines, "n long, value string").repartition(6)
    head = load_head(df, 7, "n")
    assert [r["n"] for r in head.orderBy("n").collect()] == list(range(7)) and "rangepartitioning" not in _plan(head)
    found = [(r["line_no"], r["n"]) for r in numbered_errors(df, ["n"], 4).collect()]
    assert found == [(i + 1, i) for i in range(900) if i % 37 == 5 and i % 11][:4]
    assert numbered_errors(df.where("value <> 'no tab'"), ["n"], 4).collect() == []
    seen, want = Counter(), []
    for i, v in lines:
        if "\t" in v:
            seen[v.split("\t")[0]] += 1
            if seen[v.split("\t")[0]] > 1:
                want.append((i, v.split("\t")[0], seen[v.split("\t")[0]]))
    got = duplicate_id_lines(df, ["n"])
    assert sorted((r["n"], r["id"], r["occurrence"]) for r in got.collect()) == want


def test_combined_sketches_find_the_heavy_hitters(spark):
    from tessera.operators.analytics import top_values, top_values_sketched
    rng = random.Random(2)
    df = spark.createDataFrame([(int(rng.paretovariate(1.1)), i % 7) for i in range(4000)] + [(None, 1)], "item long, day int").repartition(5)
    want = [tuple(r) for r in top_values(df.where("item is not null"), "item", 10).collect()]
    assert [tuple(r) for r in top_values_sketched(df, "item", F.col("day"), 10).collect()] == want
    rough = {r["item"]: r["count"] for r in top_values_sketched(df, "item", F.col("day"), 5, max_items=64).collect()}
    assert set(rough) >= {i for i, _ in want[:3]}
