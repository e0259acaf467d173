import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.chunk import chunk_text

WS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0        　"


def _one(spark, col, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(col).collect()]


def test_strip_matches_python(spark):
    vals = [f"{WS}abc{WS}", "​x​", "﻿y", "", "   ", "a b", "\x1fz\x1f", "😀 ", "x\n"]
    assert _one(spark, tx.py_strip("t"), vals) == [v.strip() for v in vals]


def test_flatten_keeps_cr(spark):
    vals = ["a\nb\tc\rd", "  x\n"]
    assert _one(spark, tx.flatten_text("t"), vals) == [v.replace("\n", " ").replace("\t", " ").strip() for v in vals]


def _py_clean(t):
    t = re.sub(r"\s+", " ", t)
    t = re.sub(r'[^一-龥a-zA-Z0-9\s，。！？；：、"（）【】《》]', "", t)
    return t.strip()


def test_clean_text_matches_python(spark):
    vals = ["Hello, world! It's \"fine\".", "中文，测试。　ok", "é à ü ß", "a  b", "(x) [y] 【z】"]
    assert _one(spark, tx.clean_text("t"), vals) == [_py_clean(v) for v in vals]


def test_preview_and_wrap(spark):
    assert _one(spark, tx.preview("t", 3), ["abcd", "abc"]) == ["abc...", "abc"]
    assert _one(spark, tx.wrap_instruction("t", "Q: {text} $1 \\"), ["a$0"]) == ["Q: a$0 $1 \\"]
    assert _one(spark, tx.wrap_instruction("t", ""), ["same"]) == ["same"]
    assert _one(spark, tx.char_length("t"), ["a😀中"]) == [3]


def test_chunks_of_hand_written_texts(spark):
    texts = ["", "short", "a" * 9, "a" * 10, "one paragraph.", "para one is here\n\npara two is here", "p" * 25 + "\n\n" + "q" * 25,
             "first sentence here。second sentence！third one？", "x" * 20 + "\n\n" + "s one is 15 long。" + "s" * 40 + "。tail of it is 20 ch.",
             "k" * 60]
    assert _one(spark, chunk_text("t", 40, 10, 40), texts) == [
        [], [], [], ["a" * 10], ["one paragraph."], ["para one is here\npara two is here"], ["p" * 25, "q" * 25],
        # longer than 40: packed by sentences
        ["first sentence here second sentence", "third one"][:1], ["x" * 20, "s one is 15 long", "s" * 40, "tail of it is 20 ch."],
        ["k" * 40]]


def test_chunk_properties(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "中文", "x" * 40, "y" * 700]
    texts = []
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))))
            parts.append(rng.choice(["。", "！", "\n", "\n\n", " ", "？", "\n\n\n"]))
        texts.append("".join(parts))

    def squeezed(s):
        return re.sub(r"[。！？\s]", "", s)
    for text, whole, cut in zip(texts, _one(spark, chunk_text("t", 512, 1, 10**6), texts), _one(spark, chunk_text("t", 60, 5, 30), texts)):
        # without length limits no character but separators is lost, and the order stays
        assert squeezed("".join(whole)) == squeezed(text)
        assert all(5 <= len(c) <= 30 for c in cut)
        # two neighbouring chunks never fit in one, unless a long paragraph begins or ends between them
        assert all(len(a) + len(b) + 1 > 512 for a, b in zip(whole, whole[1:])) or any(len(p) > 512 for p in text.split("\n\n"))


def test_tokens_and_counts(spark):
    assert _one(spark, tx.tokens("t"), ["Hello, World! 42x ÉTÉ"]) == [["hello", "world", "42x", "été"]]
    assert _one(spark, tx.token_count("t", "words"), ["a b  c"]) == [3]
    assert _one(spark, tx.token_count("t"), ["a b  c"]) == [6]
    assert _one(spark, tx.id_too_long("t"), ["x" * 64, "é" * 33]) == [False, True]
    assert _one(spark, tx.fuzzy_prefix(F.col("t"), F.lit(0)), ["x"]) == ["[副本1] x"]


def test_synth_text_rules(spark):
    from tessera.functions.synth import EN_TEMPLATES, synth_text
    df = spark.range(0, 50).select(F.col("id"), synth_text("id", "en", 42, 50, 200).alias("t"),
                                   synth_text("id", "zh", 42, 50, 200).alias("z"))
    for r in df.collect():
        assert 50 <= len(r["t"]) <= 200 and len(r["z"]) <= 200
        head = EN_TEMPLATES[r["id"] % 10].split("{}")[0]
        assert r["t"].startswith(head)
    again = spark.range(0, 50).repartition(5).select("id", synth_text("id", "en").alias("t"))
    assert sorted(map(tuple, again.collect())) == sorted((r["id"], r["t"]) for r in df.collect())


def test_caller_tokenizer(spark):
    from tessera.operators.tokens import count_tokens_with

    def factory():
        return lambda s: len(s.split())

    df = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(count_tokens_with("t", factory)).collect()] == [3, 0, 0]
