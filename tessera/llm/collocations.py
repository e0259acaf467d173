"""Phrase collocations counted by prefix-free parsing.

A document is a sequence of words with a break between its pieces (parts between punctuation
marks or line ends).  Wherever the hash of the eight bytes from a token's start is 0 modulo
``PERIOD``, a new chunk begins, and the chunk before it reaches ``max_words - 1`` tokens further;
breaks at the end close the last one.  Where a chunk begins depends on the text alone, so copies
and common passages give the same chunks: a *dictionary* of distinct chunks with the frequency of
each in the parse, per language.  Phrases are counted inside the distinct chunks, weighted by
those frequencies.  Two neighbouring chunks overlap by ``max_words - 1`` tokens; a phrase is
counted where it begins before the overlap, so each occurrence counts once.

A phrase with ``min_count`` occurrences has parts with as many, so only phrases are counted whose
parts may be frequent.  The hashes of the frequent parts (words first, then the phrases of each
length but the last, which are counted by ``HASH_BITS`` bits of their hashes for this) are marked in bitmaps of
at most 2 to the power ``MAX_BITS`` bits, which are broadcast.  A hash marked by chance costs a
row of the shuffle, never a result; the phrases themselves are counted exactly.

Scores are computed in whole decimals of 38 digits.  The ranking takes the first rows of hash
groups before those of a language, so no task sorts all candidates of a language.

Defined cases: null texts have no words, a null language is ``und``; pieces without words hold no
phrases; repeated rows count as often as they come; a very long text is cut into chunks like any
other (of one word repeated throughout, it is one chunk or as many as words); a word of any
length is one token; ties go by score, count and the phrase's UTF-8 bytes, and a phrase is
unique within its language; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise, small

#: average tokens of a chunk
PERIOD = 64
MAX_BITS, HASH_BITS = 27, 40
#: tokens of the chunks whose phrases a task counts at once
TOKENS_AT_ONCE = 1 << 20
BREAK = "."
_SPREAD = np.random.default_rng(12).integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# letters in lower case, every separator as one of them (a word never holds one), tab as space
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK.encode() * 9 + b" ")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(text: str | None, overlap: int) -> list[bytes]:
    """The parse of a text: chunks of tokens joined by spaces."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(BREAK.encode(), b" . ").split()
    if not tokens:
        return []
    flat = b" ".join([*tokens, *[BREAK.encode()] * overlap])
    data = np.frombuffer(flat + b" " * 8, np.uint8)
    starts = np.r_[0, np.flatnonzero(data[:len(flat)] == 32) + 1]
    # eight bytes from a token's start tell where a chunk begins
    first = starts[1:len(tokens)]
    eight = np.zeros(len(first), np.uint64)
    for i in range(8):
        eight |= data[first + i].astype(np.uint64) << np.uint64(8 * i)
    begins = [0, *(np.flatnonzero(_mixed(eight * _SPREAD[0]) % np.uint64(PERIOD) == 0) + 1).tolist(), len(tokens)]
    ends = np.r_[starts, len(flat) + 1]
    return [flat[starts[a]:ends[b + overlap] - 1] for a, b in zip(begins, begins[1:])]


def dictionary(docs: DataFrame, text_col: str, lang_col: str, overlap: int) -> DataFrame:
    """The distinct chunks of each language and their frequencies in the parse."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [chunks(t, overlap) for t in b["text"].to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
                yield pa.RecordBatch.from_arrays([b["lang"].take(rows), pa.array([c for own in found for c in own], pa.string())],
                                                 ["lang", "chunk"])

    parsed = (docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
              .mapInArrow(run, "lang string, chunk string"))
    return parsed.groupBy("lang", "chunk").agg(F.count("*").alias("times"))


class _Tokens:
    """The tokens of a lot of chunks: (language, word) numbers, and where phrases may begin."""

    def __init__(self, b: pa.Table, overlap: int):
        lists = pc.split_pattern(b["chunk"].combine_chunks(), " ")
        words = pc.dictionary_encode(lists.flatten())
        langs = pc.dictionary_encode(b["lang"].combine_chunks())
        self.words, self.langs = words.dictionary, langs.dictionary
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(len(self.words), 1)
        pair = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + code
        # the pairs that occur, numbered
        if len(self.langs) * size <= 16 * len(pair):
            seen = np.zeros(len(self.langs) * size, bool)
            seen[pair] = True
            pairs = np.flatnonzero(seen)
            number = np.zeros(len(seen), np.int32)
            number[pairs] = np.arange(len(pairs))
            self.number = number[pair]
        else:
            pairs, self.number = np.unique(pair, return_inverse=True)
        self.word_of, self.lang_of = pairs % size, pairs // size
        self.times = b["times"].to_numpy()[row]
        rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(row))
        self.word = ~pc.equal(self.words, BREAK).to_numpy(zero_copy_only=False)[code]
        self.begins = (rest > overlap) & self.word

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the language and of the word of each pair."""
        from xxhash import xxh64_intdigest

        own = (np.fromiter((xxh64_intdigest(v.encode(), 5) for v in values.to_pylist()), np.uint64, len(values)) for values in (self.langs, self.words))
        return tuple(h[at] for h, at in zip(own, (self.lang_of, self.word_of)))

    def phrases(self, at: np.ndarray, size: int) -> list[pa.Array]:
        """The language and the words, joined, of the phrases that begin at the places ``at``."""
        parts = [self.words.take(pa.array(self.word_of[self.number[at + j]])) for j in range(size)]
        return [self.langs.take(pa.array(self.lang_of[self.number[at]])), pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]]

    def counted(self, gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a place, occurrences) of each of the numbers ``gram`` at the places ``at``."""
        _, first, back = np.unique(gram[at], return_index=True, return_inverse=True)
        return at[first], np.bincount(back, weights=self.times[at]).astype(np.int64)


def _lots(batches, overlap: int):
    """The tokens of some ``TOKENS_AT_ONCE`` tokens' chunks each."""
    for whole in batches:
        if not whole.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(whole["chunk"]).to_numpy(zero_copy_only=False).astype(np.int64)) // (6 * TOKENS_AT_ONCE)
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), whole.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield _Tokens(pa.Table.from_batches([whole.slice(lo, hi - lo)]), overlap)


class Bitmap:
    """Marked hashes of frequent phrases of one length."""

    def __init__(self, bits: int, marks: np.ndarray):
        self.bits, self.marks = bits, marks

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, hashes: DataFrame) -> Bitmap:
        """Of a materialised table (h) of the first ``HASH_BITS`` bits of hashes."""
        bits = min(MAX_BITS, max(16, (64 * hashes.count()).bit_length()))
        at = (F.shiftright("h", HASH_BITS - bits) + 1).alias("at")
        marked = (hashes.select(at).groupBy(F.bitmap_bucket_number("at").alias("b"))
                  .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")))
        marks = np.zeros(1 << (bits - 3), np.uint8)
        for r in marked.collect():  # at most 2 ** MAX_BITS bits
            place = (r["b"] - 1) * 4096
            marks[place:place + 4096] = np.frombuffer(r["m"], np.uint8)
        return cls(bits, marks)


def _hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    h = lang * _SPREAD[-1] + np.uint64(len(words))
    for i, w in enumerate(words):
        h = h + w * _SPREAD[i]
    return _mixed(h)


def _grams(t: _Tokens, size: int, maps: list[Bitmap]):
    """For 2 to ``size`` words: (words, phrase number per place, places, hashes), of the phrases
    whose parts may be frequent by the ``maps`` of all smaller sizes (hashes for sizes below
    ``size``, or with ``size`` maps the last ones too, are those of the places)."""
    lang, word = t.hashes()
    fits = t.word & maps[0].holds(_hash(lang, [word]))[t.number]
    gram = t.number.astype(np.int64)
    for k in range(2, size + 1):
        fits = fits[:-1] & fits[1:]
        here = np.flatnonzero(fits)
        key, first, back = np.unique(gram[here] * len(t.word_of) + t.number[here + k - 1], return_index=True, return_inverse=True)
        gram = np.zeros(len(fits), np.int64)
        gram[here] = back
        some = here[first]
        h = _hash(lang[t.number[some]], [word[t.number[some + j]] for j in range(k)])
        if len(maps) >= k:
            held = maps[k - 1].holds(h)
            fits[here] = held[back]
            here = here[held[back]]
        yield k, gram, here[t.begins[here]], h


def _words(parse: DataFrame, overlap: int) -> DataFrame:
    """(lang, phrase, f) of all words."""
    def run(batches):
        for t in _lots(batches, overlap):
            at, f = t.counted(t.number, np.flatnonzero(t.begins))
            yield pa.RecordBatch.from_arrays([*t.phrases(at, 1), pa.array(f)], ["lang", "phrase", "f"])

    return parse.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _word_hashes(words: DataFrame) -> DataFrame:
    """(h): the hashes by which tasks know the words of a table (lang, phrase)."""
    def run(batches):
        for b in batches:
            lang, word = (np.array([xxh64_intdigest(v.encode(), 5) for v in b[c].to_pylist()], np.uint64) for c in ("lang", "phrase"))
            yield pa.RecordBatch.from_pydict({"h": pa.array((_hash(lang, [word]) >> np.uint64(64 - HASH_BITS)).astype(np.int64))})

    from xxhash import xxh64_intdigest
    return words.select("lang", "phrase").mapInArrow(run, "h bigint")


def _hash_counts(parse: DataFrame, size: int, overlap: int, frequent: list) -> DataFrame:
    """(h, f): occurrences of phrases of ``size`` words whose parts may be frequent, by the first
    ``HASH_BITS`` bits of their hashes (phrases that share them are counted together)."""
    def run(batches):
        maps = [m.value for m in frequent]
        for t in _lots(batches, overlap):
            for k, gram, at, h in _grams(t, size, maps):
                if k == size:
                    place, f = t.counted(gram, at)
                    yield pa.RecordBatch.from_pydict({"h": pa.array((h[gram[place]] >> np.uint64(64 - HASH_BITS)).astype(np.int64)), "f": pa.array(f)})

    return parse.mapInArrow(run, "h bigint, f bigint").groupBy("h").agg(F.sum("f").alias("f"))


def _phrases(parse: DataFrame, size: int, overlap: int, frequent: list) -> DataFrame:
    """(lang, phrase, size, f) of the phrases of 2 to ``size`` words that may be frequent."""
    def run(batches):
        maps = [m.value for m in frequent]
        for t in _lots(batches, overlap):
            for k, gram, at, _ in _grams(t, size, maps):
                if len(at):
                    place, f = t.counted(gram, at)
                    yield pa.RecordBatch.from_arrays([*t.phrases(place, k), pa.array(f)], ["lang", "phrase", "f"])

    return (parse.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
            .select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """The materialised tables (lang, n) of word counts and (lang, phrase, size, f) of all phrases of
    up to ``max_words`` words with at least ``min_count`` occurrences."""
    spark = docs.sparkSession
    ship_package(spark)
    overlap = max_words - 1
    parse = materialise(dictionary(docs, text_col, lang_col, overlap), "collocations-chunks")
    words = materialise(_words(parse, overlap), "collocations-words")
    totals = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")), "collocations-totals")
    own = materialise(words.where(F.col("f") >= min_count), "collocations-frequent")
    frequent = [spark.sparkContext.broadcast(Bitmap.of(materialise(_word_hashes(own), "collocations-marks")))]
    for size in range(2, max_words):
        hashes = materialise(_hash_counts(parse, size, overlap, frequent).where(F.col("f") >= min_count), "collocations-hashes")
        frequent.append(spark.sparkContext.broadcast(Bitmap.of(hashes)))
    longer = materialise(_phrases(parse, max_words, overlap, frequent).where(F.col("f") >= min_count), "collocations-phrases")
    return totals, own.select("lang", "phrase", F.lit(1).alias("size"), "f").unionByName(longer)


def _first(rows: DataFrame, keep: int, order: list) -> DataFrame:
    """The first ``keep`` rows of each language with their rank, by way of hash groups."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for groups in (parts, max(1, isqrt(parts))):
        rows = rows.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= keep)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= keep).drop("g")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10,
                 keep: int = 2000, cover: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``max_words`` words of each
    language by ``score = floor(1000000 * a * a / (l * r))`` of the cut where it is lowest, without
    those that a longer one with at least ``cover`` percent of their count covers."""
    totals, counts = phrase_counts(docs, text_col, lang_col, max_words, min_count)
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cut = phrases.select("*", cuts).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
                                           part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    sides = [small(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))) for side, f in (("left", "l"), ("right", "r"))]
    scored = cut.join(sides[0], ["lang", "left"]).join(sides[1], ["lang", "right"])
    for c in "alr":
        scored = scored.withColumn("x" + c, F.col(c).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("(cast(1000000 as decimal(38,0)) * xa * xa) div (xl * xr)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.*")
    # every shorter phrase inside a candidate, with the greatest count of those that hold it
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    held = (phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a")
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = best.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * cover))
    ranked = _first(left.select("lang", "phrase", "a", "l", "r", "score"), keep, [F.desc("score"), F.desc("a"), "phrase"])
    return (ranked.join(small(totals), "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
