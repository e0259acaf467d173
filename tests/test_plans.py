from pyspark.sql import functions as F

from tessera.operators.embed import hash_embedder_factory
from tessera.plans.corpus_preparation import prepare_collection
from tessera.plans.document_export import export_documents
from tessera.sources.bulk import read_bulk_ndjson


def test_export_documents_run_statistics(spark, tmpdir_path):
    pages = spark.createDataFrame(
        [("a.pdf", 1, "First page。It has two sentences。"), ("a.pdf", 2, ""), ("a.pdf", 3, "Third page text here。"),
         ("b.pdf", 1, "Another document with enough text。")],
        "source_file string, page_no int, page_text string")
    run = export_documents(spark, pages, tmpdir_path + "/bulk", hash_embedder_factory(8), 8, target_count=10).first()
    assert run["total_documents"] == 10 and run["total_vectors"] == 10
    assert run["total_time_seconds"] >= run["export_time"] >= 0
    back = read_bulk_ndjson(spark, tmpdir_path + "/bulk",
                            "text string, vector array<double>, source_file string, chunk_id int, repeat_id int")
    rows = back.collect()
    assert len(rows) == 10 and len({r["_id"] for r in rows}) == 10
    assert all(len(r["doc"]["vector"]) == 8 for r in rows)


def test_prepare_collection_validates_written_files(spark, tmpdir_path):
    acc = spark.createDataFrame([(i, f"accepted text {i}") for i in range(30)], "k long, text string")
    r = prepare_collection(spark, acc, tmpdir_path + "/c", "k").first()
    assert (r["total_lines"], r["valid_lines"], r["malformed_lines"], r["unique_ids"]) == (30, 30, 0, 30)
    assert r["passed"] is True
    assert spark.read.text(r["path"]).filter(F.col("value").startswith("0\t")).count() == 1
