import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.expand import expand_documents
from tessera.operators.ordinals import dense_id
from tessera.operators.sample import sample_documents
from tessera.operators.validate import validate_collection
from tessera.sinks.corpus import write_collection
from tessera.sources import corpus

EDGE = ["1\thello world", "", "   ", "no tab here", "2\ta\tb", "3\t", "1\tduplicate id here",
        "4\t" + "x" * 9, "5\t" + "x" * 10, "6\t" + "x" * 512, "7\t" + "x" * 513,
        "8\t　padded text　", "9\t​zero width​", "10\tsay \"hi\" 😀 ok"]


def _lines(spark, rows):
    return spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "value string, line int")


def test_parse_collection_edges(spark):
    got = {r["id"]: r["text"] for r in corpus.parse_collection(_lines(spark, EDGE)).collect()}
    expected = {}
    for line in EDGE:
        parts = line.strip().split("\t")
        if len(parts) == 2 and 10 <= len(parts[1]) <= 512:
            expected.setdefault(parts[0], parts[1])
    assert set(got) == set(expected)
    assert got["9"] == "​zero width​"
    assert "4" not in got and "5" in got and "6" in got and "7" not in got


def test_validate_collection_counts(spark):
    r = validate_collection(_lines(spark, EDGE)).first()
    assert r["total_lines"] == len(EDGE)
    assert r["empty_lines"] == 2
    assert r["malformed_lines"] == 3  # "no tab here", "2\ta\tb", "3\t" (strip removes the tab)
    assert r["valid_lines"] == len(EDGE) - 5
    assert r["duplicate_ids"] == 1 and r["passed"] is False


def test_json_text_rules(spark, tmpdir_path):
    lines = ['{"text":"hello there world"}', '{"text":5}', '{"text":null}', '{"x":1}', "[1]", "bad",
             json.dumps({"text": "line\nbreak and\ttab here"})]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    got = [r["text"] for r in corpus.read_json_text(df, min_length=0).collect()]
    assert sorted(got) == sorted(["hello there world", "", "line break and tab here"])


def test_write_then_read_collection(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"text number {i}\r") for i in range(50)], "k long, text string")
    path = write_collection(df, tmpdir_path + "/c", "k")
    back = corpus.read_collection(spark, path, keep_order_key=True)
    rows = sorted((int(r["id"]), r["text"]) for r in back.collect())
    # CR -> space on write; the reader strips the whole line (trailing space goes)
    assert rows == [(i, f"text number {i}") for i in range(50)]


def test_dense_id_partition_invariant(spark):
    base = spark.range(0, 5000).select((F.col("id") * 7919 % 10007).alias("k"), F.col("id").alias("v"))
    ref = None
    for parts in (1, 4, 16):
        d = dense_id(base.repartition(parts), "k", name="n", buckets=parts)
        got = sorted((r["k"], r["n"]) for r in d.collect())
        assert [n for _, n in got] == list(range(5000))
        ref = ref or got
        assert got == ref
    two = dense_id(spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "s string, t int"), ["s", "t"],
                   name="n", buckets=2)
    assert sorted((r["s"], r["t"], r["n"]) for r in two.collect()) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 2)]


def test_sample_exact_k_and_paths_agree(spark):
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("id"))
    small = {r["id"] for r in sample_documents(df, 700, seed=42).collect()}
    large = {r["id"] for r in sample_documents(df.repartition(7), 700, seed=42).collect()}
    assert len(small) == 700 and small == large
    assert sample_documents(df, 5000).count() == 3000


def test_expand_exact_target(spark):
    df = spark.createDataFrame([(f"d{i}", f"text {i}", i) for i in range(7)], "id string, text string, k int")
    out = expand_documents(df, 23, "k")
    rows = out.collect()
    assert len(rows) == 23 and len({r["id"] for r in rows}) == 23
    last = sorted(r["k"] for r in rows if r["repeat_id"] == 3)
    assert last == [0, 1]
    same = expand_documents(df, 5, "k")
    assert same.count() == 7 and same.columns == out.columns and same.filter("repeat_id is not null").count() == 0
    assert expand_documents(df, 7, "k").count() == 7 and expand_documents(df, 8, "k").count() == 8
    fuzzy = expand_documents(df, 23, "k", strategy="fuzzy")
    assert fuzzy.count() == 23
    assert fuzzy.filter(F.col("id") == "d0_fuzzy_2").first()["text"] == "[副本3] text 0"


def test_read_corpus_dispatch(spark, tmpdir_path):
    import os
    p = tmpdir_path + "/j"
    os.makedirs(p)
    with open(p + "/a.jsonl", "w") as f:
        f.write('{"text":"first text line"}\n{"text":7}\n{"body":"x"}\n')
    got = [r["text"] for r in corpus.read_corpus(spark, p, "json", min_length=0).collect()]
    assert sorted(got) == ["", "first text line"]
    spark.createDataFrame([("hello parquet world",), (None,)], "text string").write.parquet(tmpdir_path + "/pq")
    got = sorted(r["text"] for r in corpus.read_corpus(spark, tmpdir_path + "/pq", "parquet", min_length=0).collect())
    assert got == ["None", "hello parquet world"]


def test_scan_document_dir(spark, tmpdir_path):
    import os
    from tessera.sources.pages import assemble_pages, scan_document_dir
    d = tmpdir_path + "/pdfs"
    os.makedirs(d)
    for name, body in (("a.pdf", b"p1|p2"), ("B.PDF", b"only"), ("bad.pdf", b"FAIL"), ("c.txt", b"skip")):
        with open(f"{d}/{name}", "wb") as f:
            f.write(body)

    def extract(data: bytes):
        if data == b"FAIL":
            raise ValueError("unreadable")
        return data.decode().split("|")

    pages = scan_document_dir(spark, d, extract)
    rows = sorted((r["source_file"], r["page_no"], r["page_text"]) for r in pages.collect())
    assert rows == [("B.PDF", 1, "only"), ("a.pdf", 1, "p1"), ("a.pdf", 2, "p2")]
    texts = {r["source_file"]: r["text"] for r in assemble_pages(pages).collect()}
    assert texts["a.pdf"] == "p1\n\np2\n\n"
    assert scan_document_dir(spark, tmpdir_path + "/missing", extract).count() == 0
    from tessera.sources.pages import scan_failures
    failed = {r["source_file"] for r in scan_failures(spark, d, extract).collect()}
    read = {r["source_file"] for r in pages.collect()}
    assert not failed & read and scan_failures(spark, tmpdir_path + "/missing", extract).count() == 0


def test_expand_partition_invariant(spark):
    df = spark.createDataFrame([(f"d{i}", f"t{i}", i) for i in range(37)], "id string, text string, k int")
    ref = None
    for parts in (1, 4, 16):
        got = sorted(r["id"] for r in expand_documents(df.repartition(parts), 100, "k").collect())
        assert len(got) == 100
        ref = ref or got
        assert got == ref


def test_validate_check_lines_cut(spark):
    from tessera.operators.validate import validate_collection
    rows = ["1\tgood line one", "bad", "2\tgood line two", "alsobad"]
    df = spark.createDataFrame([(v, i + 1) for i, v in enumerate(rows)], "value string, line int")
    r = validate_collection(df, check_lines=2, line_no_col="line").first()
    assert (r["total_lines"], r["valid_lines"], r["malformed_lines"]) == (4, 1, 1)
    with pytest.raises(ValueError):
        validate_collection(df, check_lines=2)


def test_dense_id_by_groups_matches_global(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 3000).select((F.col("id") % 7).alias("f"), (F.col("id") * 13 % 3001).alias("r"))
    a = sorted((r["f"], r["r"], r["n"]) for r in dense_id(df, ["f", "r"], name="n", bucket_prefix=1).collect())
    b = sorted((r["f"], r["r"], r["n"]) for r in dense_id(df, ["f", "r"], name="n", buckets=4).collect())
    assert a == b and [x[2] for x in sorted(a, key=lambda t: t[2])] == list(range(3000))
