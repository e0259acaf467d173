"""What a task holds doesn't grow with the input: token cache, files read whole, ranges, parsed lines."""

import os
from glob import glob

import pytest
from pyspark.sql import functions as F

from tessera.operators import embed as em
from tessera.plans import registry
from tessera.session import checkpoint_root
from tessera.sources.corpus import json_text


def _files(spark, name):
    return {f for f in glob(f"{checkpoint_root(spark).removeprefix('file:')}/{name}-*/part-*")}


@pytest.fixture
def many_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_token_cache_is_bounded():
    model = em.HashEmbedder(8)
    model([" ".join(f"w{i}" for i in range(100_000))])
    assert len(model._cache) <= 1 << 15
    assert (model(["w99999"]) == em.HashEmbedder(8)(["w99999"])).all()


def test_page_files_are_bounded(spark, tmp_path):
    spark.range(2500).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>\n"), F.col("id").cast("string")).alias("html")).coalesce(1) \
        .write.parquet(str(tmp_path / "pages.parquet"))
    before = _files(spark, "page-files")
    rows = registry.q_scan_page_files(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows) == [(i, 4 + len(str(i))) for i in range(2500)]
    assert len(_files(spark, "page-files") - before) == 3


def test_ordered_files_follow_the_tasks(spark, tmp_path, many_tasks):
    spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text")) \
        .write.parquet(str(tmp_path / "documents.parquet"))
    before = _files(spark, "ordered")
    assert [r["doc_id"] for r in registry.q_corpus_max_samples(spark, str(tmp_path)).collect()] == list(range(40))
    assert len(_files(spark, "ordered") - before) > 4


def test_rows_are_dealt_before_costly_expressions(spark, tmp_path, many_tasks):
    spark.createDataFrame([(1, "a  b\t\x1c c  d' "), (2, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("clean_text", "embed_with_instruction"):
        assert registry.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 9
    assert dict(registry.q_clean_text(spark, str(tmp_path)).collect()) == {1: "a b c d", 2: None}


def test_a_json_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(x,) for x in ('{"text":"a"}', '{"text":null}', '{"text":3}', '{"x":1}', "[1]", "{", None)], "value string")
    got = lines.select(json_text(F.col("value")).alias("t"))
    assert [r["t"] for r in got.collect()] == ["a", None, None, "", None, None, None]
    assert got._jdf.queryExecution().analyzed().toString().lower().count("parse_json") == 1


def test_cleaning_keeps_the_same_of_every_character(spark):
    """The drop pattern, written for speed, against the plain class, on all code points."""
    from tessera.functions import text as tx
    point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    w = spark.range(0x110000).where("id < 55296 or id > 57343").groupBy((F.col("id") / 64).cast("long")).agg(F.concat_ws("", F.collect_list(point)).alias("x"))
    x = F.concat(F.lit(" a  b "), F.col("x"), F.lit("  c"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(x, f"{tx.STRIP_CLASS}+", " "), f"[^{tx.CLEAN_KEEP}]+", ""))
    assert w.where(~tx.clean_text(x).eqNullSafe(plain)).count() == 0
    assert tx._dropped(r"\p{L}") == r"[^\p{L}]+"
