"""Repeated passages by sparse suffix arrays.

Of every document's suffixes only those that start at a minimiser are kept: the positions whose
hash of the next ``SEED`` words is the least of some ``min_words - SEED + 1`` neighbouring ones.
The choice depends on the words alone, so two copies of a passage of ``min_words`` words keep
the same suffixes.  Suffixes whose seed no other document has are dropped.  The others are
sorted by seed and by the words that follow; each is compared with its neighbours of other
documents in that order (the longest common continuations), the match is extended to the right
and to the left, and counts if it has at least ``min_words`` words.  Seeds lie close together,
so extending by ``min_words - SEED`` words either way is enough: the matches of a long passage
overlap and are merged.

The sort is a range sort over the whole table, so a passage that a third of the documents share
is spread over many tasks; the ends of the ranges are compared separately.  A suffix may share
``min_words`` words with a third document that isn't its neighbour in this order: of the suffixes
with a common window of ``min_words`` words, only the first of each chain of neighbours that share
it asks for it.  Seeds with several asking suffixes are sorted by the words before the seed, too;
where the reaches in both orders leave windows possible that a suffix doesn't share with its
predecessor, they are settled by their hashes.  So the stretches are exactly the words in windows
of ``min_words`` words that another document has, too; ``others`` needn't list every document with
such a window, but links all of them, directly or through others' rows.

Words are compared by 64-bit hashes within seeds and by 16 bits each beyond them.

Defined cases: null and short texts have no passages; rows equal in id and text are one document
(they don't repeat each other); rows with a null id take part; repeats within one document don't
count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import ROWS_AT_ONCE, give_back_memory, map_rows, materialise, small

MIN_WORDS, SEED = 50, 20
#: bytes of text that a task hashes at once, unless one text is longer
TEXT_AT_ONCE = 2 << 20
#: suffixes whose contexts a task cuts at once
PLACES_AT_ONCE = 1 << 14
#: rows that a task collects before it gives them out
ROWS_OUT = 4096
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _column(values: pa.Array) -> list:
    """The values as Python objects."""
    if values.null_count == 0 and pa.types.is_integer(values.type):
        return values.to_numpy().tolist()
    if values.null_count == 0 and pa.types.is_binary(values.type):
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].tolist()
        data = values.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
        return [data[i - ends[0]:j - ends[0]] for i, j in zip(ends, ends[1:])]
    return values.to_pylist()


def _groups(batches):
    """The rows in groups of some hundred, fewer where the texts are long."""
    for b in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
            if i > at and (size + n > TEXT_AT_ONCE or i - at == ROWS_AT_ONCE):
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < b.num_rows:
            yield b.slice(at)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and where each text begins and
    the last one ends."""
    from xxhash import xxh64_intdigest

    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    of, words = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False)), split.flatten()
    some = pc.greater(pc.binary_length(words), 0)  # spaces at the ends leave empty words
    of, words = of[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
    hashes = np.fromiter((xxh64_intdigest(w, 7) for w in _column(words.dictionary.cast(pa.binary()))), np.uint64, len(words.dictionary))
    return hashes[words.indices.to_numpy(zero_copy_only=False)], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(split)))])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every window of ``size`` words."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    powers, inverses = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    return _mixed((sums[size:] - sums[:-size]) * inverses[: n - size + 1])


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    span = 1
    while span < size:
        step = min(span, size - span)
        values, span = pick(values[:-step], values[step:]), span + step
    return values


def minimisers(hashes: np.ndarray, window: int, fits: np.ndarray | None = None) -> np.ndarray:
    """The positions that are least in some window of ``window`` hashes (all that tie), of the windows
    that fit, if that's given by their first places."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, window, np.minimum)
    if fits is not None:
        least = np.where(fits, least, np.uint64(0))
    # the greatest of the minima of all windows around a position, edges repeated
    around = _sliding(np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]), window, np.maximum)
    return np.flatnonzero(around == hashes)


def _contexts(words: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int, reach: int) -> tuple[pa.Array, pa.Array]:
    """16 bits per word: after the seeds at ``at``, and before them in reverse, within ``first`` to ``end``."""
    short, steps = (words >> np.uint64(48)).astype(">u2"), np.arange(reach)

    def cut(places, inside):
        data = short[np.where(inside, places, 0)][inside].tobytes() if len(short) else b""
        ends = np.concatenate([[0], np.cumsum(2 * inside.sum(axis=1))]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    after, before = at[:, None] + seed + steps, at[:, None] - 1 - steps
    return cut(after, after < end[:, None]), cut(before, before >= first[:, None])


def _common(a: bytes, b: bytes) -> int:
    """Leading words that two contexts share."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (8 * n - differ.bit_length()) // 16


def _commons(contexts: list[bytes]) -> list[int]:
    """The leading words that each context but the first shares with the one before it."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) // 2
    most = int(sizes.max(initial=0))
    words = np.frombuffer(b"".join(c.ljust(2 * most, b"\0") for c in contexts), np.uint16).reshape(len(contexts), most)
    differ = np.concatenate([words[1:] != words[:-1], np.ones((max(len(contexts) - 1, 0), 1), bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1])).tolist()


_ROW = ("h", "after", "before", "ref", "pos", "id", "n")
_FOUND = ("ref", "id", "begin", "stop", "other")
_ASK = ("right", "skip_left", "skip_right", "mate_left", "mate_right", "mate_ref", "mate")


class _Neighbours:
    """Compares a stream of suffixes, sorted by seed and one context, with their nearest
    neighbours of other documents.  ``reach`` is a suffix's longest common context in that order:
    no suffix of another document shares more.

    A window is named by its number of words before the seed.  In the order by ``after``, a suffix
    skips the windows from ``min_words - seed - skip_right`` to ``skip_left``: it shares them with the
    suffix just before it, directly or as a repeat in one document, and with a neighbour of another
    document.  A suffix that may share further windows asks, with its reach to the ``right`` and the
    following document (``mate``) with the words that they share.  In the order by ``before``, those
    that asked also get their reach to the ``left``, and ask on if windows are left."""

    def __init__(self, seed: int, min_words: int, by: str = "after"):
        self.seed, self.min_words, self.by, self.found, self.asks = seed, min_words, by, [], []
        self.run: list[dict] = []  # the last suffixes, of one document and one seed
        self.other: dict | None = None  # the suffix before them
        self.whole = False  # the seed began in this stream

    def add(self, x: dict) -> None:
        """``x`` may tell the words (``near``) that it shares with the row before it, and comes with
        what it asks, if it does (``ask``)."""
        if x.get("ask"):
            x.update(x["ask"])
        last = self.run[-1] if self.run else None
        if last is None or last["h"] != x["h"]:
            self.leave(self.whole)
            # what stands before the stream's first seed is unknown
            self.run, self.other, self.whole = [x], None, last is not None
            x["reach"] = 0 if self.whole else self.min_words
            return
        if last["ref"] == x["ref"]:
            if last["pos"] == x["pos"]:  # a repeated row, or one with what the suffix asks
                if x.get("right") is not None:
                    last.update((c, x[c]) for c in _ASK)
                return
            self.run.append(x)
            x["reach"] = 0 if self.whole or self.other is not None else self.min_words
            if self.by == "after" and x["n"] > 2:
                x["repeat"] = x.get("near") or self.shared(x, last)
            if self.other is not None:
                self.note(x, self.other, "prev", self.shared(x, self.other))
        else:
            x["reach"] = 0
            near = x.get("near") or self.shared(x, last)
            for y in self.run[:-1]:
                self.note(y, x, "next", self.shared(y, x))
            self.note(last, x, "next", near)
            self.leave(True)
            self.run, self.other = [x], last
            self.note(x, last, "prev", near)

    @staticmethod
    def shared(x: dict, y: dict) -> tuple[int, int]:
        return _common(x["before"], y["before"]), _common(x["after"], y["after"])

    def leave(self, known: bool) -> None:
        """The run has met all its neighbours, unless they may lie beyond an end of the stream."""
        most = self.min_words - self.seed
        for y in self.run:
            if y["n"] <= 2:
                continue
            reach = min(y["reach"] if known else self.min_words, most)
            if self.by == "before":
                right = y.get("right")
                if right is not None and reach + right >= most and (y["skip_left"] < reach or y["skip_right"] < right):
                    self.asks.append({c: y[c] for c in _ROW + _ASK} | {"left": reach})
                continue
            skip = self.skipped(y)
            left, right = len(y["before"]) // 2, min(reach, len(y["after"]) // 2)
            if left + right >= most and (skip[0] < left or skip[1] < right):
                mate = y.get("next") or (-1, -1, None, None)
                self.asks.append({c: y[c] for c in _ROW} | dict(zip(_ASK, (right, *skip, *mate))) | {"left": None})

    def skipped(self, x: dict) -> tuple[int, int]:
        near = [x[side][:2] for side in ("prev", "next") if side in x]
        if "repeat" in x:
            # the document's last suffix answers for the window, a neighbour shows that it's shared
            near = [(min(left, x["repeat"][0]), min(right, x["repeat"][1])) for left, right in near]
        elif "prev" not in x:
            return -1, -1
        best = max(near, key=sum, default=(-1, -1)) if "repeat" in x else near[0]
        return best if sum(best) >= self.min_words - self.seed else (-1, -1)

    def note(self, x: dict, y: dict, side: str, near: tuple[int, int]) -> None:
        left, right = near
        reach = right if self.by == "after" else left
        if x["reach"] < reach:
            x["reach"] = reach
        if y["reach"] < reach:
            y["reach"] = reach
        x[side] = left, right, y["ref"], y["id"]
        if left + self.seed + right >= self.min_words:
            self.found.append((x["ref"], x["id"], x["pos"] - left, x["pos"] + self.seed + right, y["id"]))

    def take(self) -> tuple[list[tuple], list[dict]]:
        out = self.found, self.asks
        self.found, self.asks = [], []
        return out


def candidate_suffixes(docs: DataFrame, min_words: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """The materialised suffixes (h, after, before, ref, pos, id, n) whose seed occurs in more
    than one document; ``n`` counts the seed's occurrences."""
    kind, reach = docs.schema[id_col].dataType.simpleString(), min_words - seed
    ship_package(docs.sparkSession)
    docs = docs.select(F.xxhash64(id_col, text_col).alias("ref"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def select(batches):
        for b in _groups(batches):
            words, starts = word_hashes(b.column("text"))
            of = np.repeat(np.arange(b.num_rows), np.diff(starts))
            h = window_hashes(words, seed)
            # windows of min_words words that lie in one text
            at = minimisers(h, reach + 1, of[:len(h) - reach] == of[min_words - 1:]) if len(words) >= min_words else np.zeros(0, np.int64)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), b.column("ref").take(pa.array(of[at])),
                                                  pa.array((at - starts[of[at]]).astype(np.int32))], ["h", "ref", "pos"])
        give_back_memory()

    kept = materialise(docs.select("ref", "text").mapInArrow(select, "h bigint, ref bigint, pos int"), "suffix-seeds")
    often = materialise(kept.groupBy("h").agg(F.count("*").alias("n"), F.min("ref").alias("a"), F.max("ref").alias("b"))
                        .where("a <> b").select("h", "n"), "suffix-often")
    places = kept.join(often, "h").repartition("ref").groupBy("ref").agg(F.collect_set(F.struct("pos", "h", "n")).alias("at"))

    def context(batches):
        for b in _groups(batches):
            words, starts = word_hashes(b.column("text"))
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("at")).to_numpy(zero_copy_only=False))
            at = pa.RecordBatch.from_struct_array(b.column("at").flatten())
            for i in range(0, len(of), PLACES_AT_ONCE):
                part, doc = at.slice(i, PLACES_AT_ONCE), of[i:i + PLACES_AT_ONCE]
                after, before = _contexts(words, starts[doc] + part["pos"].to_numpy(), starts[doc], starts[doc + 1], seed, reach)
                yield pa.RecordBatch.from_arrays([part["h"], after, before, b.column("ref").take(pa.array(doc)), part["pos"],
                                                  b.column("id").take(pa.array(doc)), part["n"]], list(_ROW))
        give_back_memory()

    return materialise(docs.join(places, "ref").mapInArrow(context, f"h bigint, after binary, before binary, ref bigint, pos int, id {kind}, n bigint"),
                       "suffix-contexts")


def neighbour_matches(suffixes: DataFrame, min_words: int, seed: int, by: str = "after") -> tuple[DataFrame, DataFrame]:
    """The matches (ref, id, begin, stop, other) of suffixes with their neighbours in the order of the
    seed and the context ``by``, and those suffixes of seeds that occur three times or more that ask
    for windows (with the reach to the right, the windows to skip and the mate, and by ``before``
    the reach to the left).  By ``before``, the suffixes that asked come a second time, with what
    they asked."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = suffixes.sparkSession
    ship_package(spark)
    kind = suffixes.schema["id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h", by, "before" if by == "after" else "after", "ref", "pos"]
    found = f"ref bigint, id {kind}, begin int, stop int, other {kind}"
    row = f"h: bigint, after: binary, before: binary, ref: bigint, pos: int, id: {kind}, n: bigint"
    ask = f"{row}, right: int, skip_left: int, skip_right: int, mate_left: int, mate_right: int, mate_ref: bigint, mate: {kind}, left: int"
    schema = found + f", ask struct<{ask}>, edge struct<part: int, {row}>"
    target = to_arrow_schema(_parse_datatype_string(schema))
    names = [c for c in (*_ROW, "ask") if c in suffixes.columns]

    def compare(batches):
        # besides matches and what is asked, a task reports its first and last suffixes, to be compared
        # across the ends of the ranges
        from pyspark import TaskContext

        part, near, head = TaskContext.get().partitionId(), _Neighbours(seed, min_words, by), []

        def rows(matches, asks, edges=()):
            n, m, k = len(matches), len(asks), len(edges)
            match = dict(zip(_FOUND, map(list, zip(*matches)))) if n else {c: [] for c in _FOUND}
            return pa.RecordBatch.from_pydict({c: v + [None] * (m + k) for c, v in match.items()}
                                              | {"ask": [None] * n + asks + [None] * k, "edge": [None] * (n + m) + list(edges)}, schema=target)

        for b in (b.slice(i, ROWS_OUT) for b in batches for i in range(0, b.num_rows, ROWS_OUT)):
            columns = [_column(b.column(c)) for c in names]
            commons = [None, *zip(_commons(columns[names.index("before")]), _commons(columns[names.index("after")]))]
            for row, common in zip(zip(*columns), commons):
                x = dict(zip(names, row))
                x["near"] = common
                if not head or len(head) == 1 and head[0]["h"] == x["h"] and head[0]["ref"] != x["ref"]:
                    head.append(x)
                near.add(x)
            if len(near.found) + len(near.asks) >= ROWS_OUT:
                yield rows(*near.take())
        if near.run:
            near.leave(False)
            tail = ([near.other] if near.other else []) + [near.run[0], near.run[-1]]
            yield rows(*near.take(), [{"part": part, **{c: x[c] for c in _ROW}} for x in head + tail])
        give_back_memory()

    both = materialise(suffixes.select(*names).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(compare, schema), "suffix-matches")
    # a few suffixes per range
    edges = sorted((r["edge"].asDict() for r in both.where("edge is not null").select("edge").collect()),
                   key=lambda x: (x["part"], *[x[c] for c in order]))
    seam = _Neighbours(seed, min_words, by)
    for x in edges:
        seam.add(x)
    return (both.where("stop is not null").select(*_FOUND).unionByName(spark.createDataFrame(seam.take()[0], found)),
            both.where("ask is not null").select("ask.*"))


def window_matches(suffixes: DataFrame, asking: DataFrame, min_words: int, seed: int) -> DataFrame:
    """Further matches of suffixes whose seed occurs three times or more.

    Such a suffix may share ``min_words`` words with a document that is its neighbour in neither
    order.  Its reach to the right bounds how far a common window must at least go to the left;
    a second sort, by the words before the seed, gives the reach to the left.  Where the two
    leave windows possible that the suffix doesn't skip, those windows are compared by their
    hashes.  All suffixes with a window are linked by neighbours to one that asks for it, so
    windows of a seed with a single asking suffix are settled, and the askers' documents and
    mates tell whether another document has the window."""
    kind, reach = suffixes.schema["id"].dataType.simpleString(), min_words - seed

    def several(asks, name):
        seeds = materialise(asks.groupBy("h").agg(F.count("*").alias("askers")).where("askers > 1").select("h"), name)
        return small(seeds)

    unsettled = several(asking, "suffix-unsettled")
    again = asking.join(unsettled, "h", "left_semi").select(*_ROW, F.struct(*_ASK).alias("ask"))
    rows = suffixes.join(unsettled, "h", "left_semi").unionByName(again, allowMissingColumns=True)
    more, open_ = neighbour_matches(rows, min_words, seed, "before")
    open_ = open_.join(several(open_, "suffix-asking"), "h", "left_semi")

    def windows(batches):
        from xxhash import xxh64_intdigest

        names = ("h", "after", "before", "ref", "pos", "id", "left", *_ASK)
        for b in batches:
            out = {c: [] for c in ("w", "ref", "id", "begin", "mate_ref", "mate")}
            for h, after, before, ref, pos, id_, most, least, skip_left, skip_right, mate_left, mate_right, mate_ref, mate in zip(*(b[c] for c in names)):
                for left in range(max(reach - least, reach - len(after) // 2, 0), min(most, len(before) // 2) + 1):
                    if reach - skip_right <= left <= skip_left:
                        continue
                    rest = b"%d:%d:" % (h, left) + before[: 2 * left] + after[: 2 * (reach - left)]
                    out["w"].append(xxh64_intdigest(rest) - (1 << 63))
                    met = reach - mate_right <= left <= mate_left
                    for c, v in zip(("ref", "id", "begin", "mate_ref", "mate"), (ref, id_, pos - left, mate_ref if met else None, mate if met else None)):
                        out[c].append(v)
            yield out

    cut = materialise(map_rows(open_, windows, f"w bigint, ref bigint, id {kind}, begin int, mate_ref bigint, mate {kind}"), "suffix-windows")
    own, mate = F.struct("ref", "id"), F.when(F.col("mate_ref").isNotNull(), F.struct(F.col("mate_ref").alias("ref"), F.col("mate").alias("id")))
    shared = materialise(cut.groupBy("w").agg(F.least(F.min(own), F.min(mate)).alias("a"), F.greatest(F.max(own), F.max(mate)).alias("b"))
                         .where("a.ref <> b.ref"), "suffix-shared")
    other = F.when(F.col("ref") == F.col("a.ref"), F.col("b")).otherwise(F.col("a"))
    return more.unionByName(
        cut.join(small(shared), "w").withColumn("o", other)
        .select("ref", "id", "begin", (F.col("begin") + min_words).alias("stop"), F.col("o.id").alias("other")))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, begin, stop, others): the stretches of words of a document that occur in other
    documents, and the ids of documents that they were matched with."""
    if not 0 < seed <= min_words:
        raise ValueError("seed must be 1 to min_words")
    suffixes = candidate_suffixes(docs, min_words, seed, id_col, text_col)
    matches, asking = neighbour_matches(suffixes, min_words, seed)
    spans = matches.unionByName(window_matches(suffixes, asking, min_words, seed))
    by_begin = Window.partitionBy("ref").orderBy("begin", "stop")
    fresh = F.col("begin") > F.coalesce(F.max("stop").over(by_begin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return (spans.withColumn("fresh", fresh.cast("int")).withColumn("stretch", F.sum("fresh").over(by_begin.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("ref", "stretch").agg(F.first("id", ignorenulls=True).alias("id"), F.min("begin").alias("begin"), F.max("stop").alias("stop"),
                                           F.sort_array(F.collect_set("other")).alias("others"))
            .select("id", "begin", "stop", "others"))
