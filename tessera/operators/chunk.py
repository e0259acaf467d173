"""Greedy text chunking (P5-P8, O6) as one Catalyst fold — no UDF.

The reference packs paragraphs (joined by a newline) while they fit; a paragraph longer
than ``chunk_size`` first flushes the current chunk and is then packed sentence by sentence
(joined by a space).  That is the same as folding once over a flat item list:

* ``P`` (a paragraph that is at most ``chunk_size`` long): append with "\\n" if it fits,
  else flush and start from it;
* ``R`` (start of a long paragraph): flush and reset;
* ``S`` (a sentence of a long paragraph): append with " " if it fits, else flush and
  start from it.

"Fits" is ``len(cur) + len(x) + 1 <= chunk_size``; a flush keeps ``cur[:max_length]`` only
when ``cur`` is non-empty and at least ``min_length`` long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import clean_text, py_strip, sentence_marks_to_cjk, split_paragraphs, split_sentences

_P, _R, _S = 0, 1, 2


def _items(text: Column, chunk_size: int, spaces_only: bool = False) -> Column:
    """Structs (s, n, k): the string, its length and its kind."""
    def item(s, kind):
        return F.struct(s.alias("s"), F.length(s).alias("n"), F.lit(kind).alias("k"))

    def per_para(p):
        long_para = F.concat(F.array(item(F.lit(""), _R)),
                             F.transform(split_sentences(p, spaces_only), lambda x: item(x, _S)))
        return F.when(F.length(p) > chunk_size, long_para).otherwise(F.array(item(p, _P)))

    return F.flatten(F.transform(split_paragraphs(text, spaces_only), per_para))


def chunk_text(text, chunk_size: int = 512, min_length: int = 10, max_length: int = 512,
               spaces_only: bool = False) -> Column:
    """``array<string>`` of chunks for one text.  The fold runs over item lengths only and
    emits cut positions (first item, number of items); the chunk strings are sliced from the
    items afterwards, so nothing grows but the short list of cuts.  ``spaces_only`` tells that
    the text holds no whitespace but ASCII spaces (it was cleaned), so strips are trims.

    ``max_length`` cuts the tail of a chunk and chunks under ``min_length`` are left out, as the
    operator is specified; with ``max_length`` at least the longest sentence and
    ``min_length=1`` nothing is lost."""
    t = F.col(text) if isinstance(text, str) else text
    cut_type = "array<struct<first:int,items:int>>"

    def emit(acc):
        cut = F.struct(acc["first"].alias("first"), acc["items"].alias("items"))
        return F.when((acc["items"] > 0) & (acc["n"] >= min_length), F.concat(acc["cuts"], F.array(cut))).otherwise(acc["cuts"])

    def step(acc, it):
        reset = it["k"] == _R
        joins = ~reset & (acc["n"] + it["n"] + 1 <= chunk_size)
        grows = joins & (acc["items"] > 0)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            F.when(grows, acc["first"]).otherwise(acc["at"]).alias("first"),
            F.when(grows, acc["items"] + 1).otherwise(F.when(reset, 0).otherwise(1)).alias("items"),
            F.when(grows, acc["n"] + it["n"] + 1).otherwise(F.when(reset, 0).otherwise(it["n"])).alias("n"),
            F.when(joins, acc["cuts"]).otherwise(emit(acc)).alias("cuts"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("items"), F.lit(0).alias("n"),
                    F.array().cast(cut_type).alias("cuts"))

    def cut_strings(items):
        def one(cut):
            # every item brings the separator that stands before it; the first one's goes
            parts = F.transform(F.slice(items, cut["first"] + 1, cut["items"]),
                                lambda x: F.concat(F.when(x["k"] == _P, "\n").otherwise(" "), x["s"]))
            return F.substring(F.array_join(parts, ""), 2, max_length)
        return F.transform(F.aggregate(items, zero, step, emit), one)

    folded = let(_items(t, chunk_size, spaces_only), cut_strings)
    # a text without a blank line that fits as one paragraph needs no fold
    single = F.trim(t) if spaces_only else py_strip(t)
    simple = (~F.instr(t, "\n\n").cast("boolean")) & (F.length(single) + 1 <= chunk_size)
    one = F.when((single != F.lit("")) & (F.length(single) >= min_length),
                 F.array(F.substring(single, 1, max_length))).otherwise(F.array().cast("array<string>"))
    return F.when(simple, one).otherwise(folded)


def prepare_text(text, clean: bool = True, latin_sentences: bool = False) -> Column:
    """Cleaning in front of the chunker; ``latin_sentences`` maps . ! ? to 。！？ first."""
    t = F.col(text) if isinstance(text, str) else text
    if latin_sentences:
        t = sentence_marks_to_cjk(t)
    return clean_text(t) if clean else t


def chunk_rows(df: DataFrame, *, text_col: str = "text", source_col: str = "source_file",
               stem_col: str | None = None, chunk_size: int = 512, min_length: int = 10,
               max_length: int = 512, clean: bool = True, latin_sentences: bool = False,
               preserve_paragraphs: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per chunk ``(id, text, source_file, chunk_id)``; ``chunk_id`` from 1,
    id ``"{stem}_chunk_{n}"``.  ``preserve_paragraphs`` cleans each paragraph separately so the
    blank-line split survives cleaning (quirk Q2); default is the reference behaviour.
    """
    stem = F.col(stem_col) if stem_col else F.regexp_replace(F.col(source_col), r"\.[^.]*$", "")
    t = F.col(text_col)
    if preserve_paragraphs:
        pieces = F.transform(F.split(t, "\n\n"), lambda p: prepare_text(p, clean, latin_sentences))
        prepared = F.array_join(pieces, "\n\n")
    else:
        prepared = prepare_text(t, clean, latin_sentences)
    keep = list(keep or [])
    # the cleaned text is projected once; the chunker references it several times
    staged = df.select(F.col(source_col).alias("source_file"), stem.alias("__stem"), *keep,
                       prepared.alias("__prep"))
    chunks = chunk_text("__prep", chunk_size, min_length, max_length, spaces_only=clean)
    return (staged.select("source_file", "__stem", *keep, F.posexplode(chunks).alias("__pos", "text"))
            .select(F.concat(F.col("__stem"), F.lit("_chunk_"), (F.col("__pos") + 1).cast("string")).alias("id"),
                    "text", "source_file", (F.col("__pos") + 1).cast("int").alias("chunk_id"), *keep))
