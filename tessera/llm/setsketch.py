"""Near duplicates by SetSketch registers over word shingles.

A document's set is its distinct shingles.  Each of ``REGISTERS`` hash functions gives every
shingle an exponential variate of rate ``RATE``; a register is the set's least variate on an
exponentially spaced scale, ``floor(1 - log_BASE(min))`` truncated to 16 bits.  A register of a
union is the greater of the registers, so sketches are mergeable, and it agrees between two
sets with about the probability of their Jaccard similarity J.

* Documents with the same set (copies) are one class; only classes are compared.
* The registers are cut into ``BANDS`` bands; classes with an equal band share a bucket.  At the
  threshold of 0.85 a pair shares no band with a chance of ``(1 - 0.85**4) ** 32``, 6e-11.
* In a first round each class is compared with one class only: of the least members of its
  buckets, the one it meets most often.  That joins large groups of near copies in linear work.
* In a second round buckets that still hold several components are compared in full, except
  within a component.  A component of ``BUCKET`` classes or more leaves the buckets: it is cut into
  tiles, which are compared with the classes outside that share a bucket with it.  Of the others, a
  bucket of up to ``BUCKET`` classes is one task's work; a larger one is cut by a second common
  band, and what stays large by tiles: the classes outside the bucket's largest component against
  all of it.  No size is capped, and no pairs are written: only the classes with a plausible
  partner go on, each once a group, to be verified there.
* A pair's J is estimated jointly from the registers that are greater, less and equal, by the
  likelihood given both set sizes.  A pair goes if the best J is more likely than the threshold
  by ``DOUBT`` nats (a chance of e-9 for a true link) or if the sizes alone rule it out.
* What remains is verified on the full sets, built again from the whole texts: in the first round
  the texts of a class's partners stream past its set, in lots of ``LOT`` partners; in the second
  a group's likeliest pairs come first, and pairs that its links have joined are skipped.

Shingles are compared by 64-bit hashes.

Defined cases: null texts and texts without words have an empty set and are linked with nothing;
with fewer words than a shingle, the whole sequence is the only shingle; repeated rows are copies;
a null id takes part but never names a component (one without any id has a null ``component_id``
and is kept); rows that repeat an id are linked by their texts alone; very long texts are sketched
and verified whole, in lots of shingles; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise, small
from .simhash import connected_components

REGISTERS, BANDS = 128, 32
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: classes of a bucket that one task compares, and their shingles; partners of a class that one task verifies
BUCKET, WEIGHT, LOT = 512, 4_000_000, 256
#: by how many nats a similarity below the threshold must be the better explanation
DOUBT = 20.0
#: rows of a sketch (some 300 bytes) up to which a table of them is broadcast
SKETCH_ROWS = 60_000
_WIDTH = 2 * REGISTERS // BANDS
_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_SPREAD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: distinct words whose hashes a task keeps
CACHE = 500_000


class Shingles:
    """Sets of 64-bit shingle hashes; word hashes are kept per task."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def of(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        # on bytes, lower() touches A-Z only and split() knows just the six ASCII blanks
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = xxh64_intdigest(w, 13)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out += h[i:len(h) - size + 1 + i] * _SPREAD[i % 64] ** np.uint64(1 + i // 64)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.unique(out ^ (out >> np.uint64(31)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at:at + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    variate = -np.log1p(-np.minimum((least.astype(float) + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _chance(x: np.ndarray) -> np.ndarray:
    """Of a register to be the greater one, by the excess of one set over the other."""
    return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-300)


def likelihood(j, more, less, equal, u):
    """Log-likelihood of the similarity ``j`` of two sets with shares ``u`` and ``1 - u`` of
    their sizes, given the counts of registers greater, less and equal."""
    above, below = _chance(u - (1 - u) * j), _chance(1 - u - u * j)
    return more * np.log(above) + less * np.log(below) + equal * np.log(np.maximum(1 - above - below, 1e-300))


def estimate(more, less, equal, u, most=None) -> np.ndarray:
    """The likeliest similarity, up to ``most`` (ternary search: the likelihood has one peak)."""
    bound = np.minimum(u / (1 - u), (1 - u) / u)
    lo, hi = np.zeros(len(u)), bound if most is None else np.minimum(bound, most)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(a, more, less, equal, u) < likelihood(b, more, less, equal, u)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def plausible(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of registers (rows of ``x`` and ``y``) may reach the threshold."""
    fits = 100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)
    at = np.flatnonzero(fits)
    if len(at):
        x, y, u = x[at], y[at], n_x[at] / (n_x[at] + n_y[at])
        more, equal = (x > y).sum(axis=1), (x == y).sum(axis=1)
        less = REGISTERS - more - equal
        limit = percent / 100
        best = likelihood(estimate(more, less, equal, u, limit), more, less, equal, u)
        fits[at] = best - likelihood(limit, more, less, equal, u) <= DOUBT
    return fits


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, REGISTERS)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """(id, text, n, digest, registers) per row: the set's size, a 128-bit digest of it and its
    registers (both null for an empty set)."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from xxhash import xxh3_128_digest

        shingles = Shingles(shingle_words)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingles.of(t) for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b["id"], b["text"], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([registers(s).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["id", "text", "n", "digest", "registers"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, text string, n bigint, digest binary, registers binary"))


def _band(i: int):
    return F.xxhash64(F.lit(i), F.substring("registers", 1 + _WIDTH * i, _WIDTH))


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers leave the threshold possible."""
    own = {c: small(sets.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")), SKETCH_ROWS)
           for c in "ab"}

    def run(batches):
        for b in batches:
            stay = plausible(_unpacked(b["r_a"].to_pylist()), _unpacked(b["r_b"].to_pylist()),
                             b["n_a"].to_numpy(), b["n_b"].to_numpy(), percent)
            yield b.select(["a", "b"]).filter(pa.array(stay))

    return pairs.join(own["a"], "a").join(own["b"], "b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a materialised table that reach the threshold on their full sets;
    ``texts`` is a materialised table (row, text)."""
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    dealt = materialise(pairs.join(small(lots), "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), "b"),
                        "setsketch-dealt")
    hubs = dealt.select("a", "lot").distinct().withColumn("b", F.lit(None).cast("bigint"))
    asked = materialise(hubs.withColumn("row", F.col("a")).unionByName(dealt.withColumn("row", F.col("b"))), "setsketch-asked")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a class and then its partners; null, the class itself, sorts first
    streams = (texts.join(small(asked), "row").select("a", "lot", "b", "text")
               .repartition(parts, "a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first()))

    def run(batches):
        shingles, hub = Shingles(shingle_words), None
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                left, right = [], []
                for x, y, text in zip(b["a"].to_pylist(), b["b"].to_pylist(), b["text"].to_pylist()):
                    own = shingles.of(text)
                    if y is None:
                        hub = own
                        continue
                    common = len(np.intersect1d(hub, own, assume_unique=True))
                    if 100 * common >= percent * (len(hub) + len(own) - common):
                        left.append(x)
                        right.append(y)
                yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return streams.mapInArrow(run, "a bigint, b bigint")


def _lots(batches, rows: int = 20_000):
    """Tables of whole groups (consecutive rows of one key) of some ``rows`` rows or more."""
    held = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table["key"].to_numpy()
            end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            held = table.slice(end).to_batches()
            if end:
                yield table.slice(0, end)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_TRIANGLE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _meetings(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that a group compares: different components, one of them "own" and the
    other "other"."""
    keys, roots, own, other = (t[c].to_numpy() for c in ("key", "root", "own", "other"))
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    left, right = [], []
    for lo, hi in zip(cuts, cuts[1:]):
        size = hi - lo
        i, j = _TRIANGLE.get(size) or np.triu_indices(size, 1)
        if size <= 64:
            _TRIANGLE[size] = i, j
        i, j = i + lo, j + lo
        stay = (roots[i] != roots[j]) & (own[i] & other[j] | own[j] & other[i])
        left.append(i[stay])
        right.append(j[stay])
    return np.concatenate(left), np.concatenate(right)


def _plausible_rows(t: pa.Table, percent: int, at_once: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, places, equal registers) of the pairs that a group has to verify: those of its rows
    that first meet in its bands and may reach the threshold."""
    regs, n, first, second = _unpacked(t["registers"].to_pylist()), t["n"].to_numpy(), t["band"].to_numpy(), t["second"].to_numpy()
    bands = regs.view(np.uint64).reshape(len(regs), BANDS)
    left, right = _meetings(t)
    found = []
    for at in range(0, len(left), at_once):
        i, j = left[at:at + at_once], right[at:at + at_once]
        shared = bands[i] == bands[j]
        fits = (first[i] < 0) | (shared.argmax(axis=1) == first[i])
        shared[np.arange(len(i)), first[i]] = False
        fits &= (second[i] < 0) | (shared.argmax(axis=1) == second[i])
        i, j = i[fits], j[fits]
        stay = plausible(regs[i], regs[j], n[i], n[j], percent)
        i, j = i[stay], j[stay]
        found.append((i, j, (regs[i] == regs[j]).sum(axis=1)))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))


_MEMBER = {"key": "bigint", "band": "int", "second": "int", "class": "bigint", "root": "bigint", "n": "bigint", "registers": "binary",
           "own": "boolean", "other": "boolean"}


def _grouped(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key")


def _unsettled(members: DataFrame, percent: int) -> DataFrame:
    """The rows of groups that have a plausible partner in another component."""
    def run(batches):
        for t in _lots(batches):
            i, j, _ = _plausible_rows(t, percent)
            yield from t.take(pa.array(np.union1d(i, j))).to_batches()

    return _grouped(members.select(*_MEMBER)).mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in _MEMBER.items()))


def _settled(rows: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Verified links (a, b) inside the groups of a materialised table of unsettled rows: the
    likeliest pairs first, and none that earlier links of the group have joined."""
    needed = materialise(rows.select(F.col("class").alias("row")).distinct(), "setsketch-needed")
    texts = texts.join(small(needed), "row", "left_semi").withColumnRenamed("row", "class")

    def run(batches):
        shingles = Shingles(shingle_words)
        for t in _lots(batches, 2_000):
            i, j, equal = _plausible_rows(t, percent)
            keys, classes, roots, text = t["key"].to_numpy(), t["class"].to_numpy(), t["root"].to_numpy(), t["text"]
            order = np.lexsort((j, i, -equal, keys[i]))
            key, left, right = None, [], []
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if keys[x] != key:
                    key, sets, up = keys[x], {}, {}

                def top(r):
                    while up.get(r, r) != r:
                        r = up[r]
                    return r
                a, b = top(roots[x]), top(roots[y])
                if a == b:
                    continue
                for place in (x, y):
                    if place not in sets:
                        sets[place] = shingles.of(text[place].as_py())
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    up[max(a, b)] = min(a, b)
                    left.append(min(classes[x], classes[y]))
                    right.append(max(classes[x], classes[y]))
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return _grouped(rows.join(texts, "class")).mapInArrow(run, "a bigint, b bigint")


def _size():
    """Of a group: its classes, or its shingles in units of ``WEIGHT / BUCKET`` if that is more."""
    return F.greatest(F.count("*"), F.ceil(F.sum("n") * BUCKET / WEIGHT))


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of buckets with several components, with the bucket's size."""
    mixed = materialise(members.groupBy("key").agg(_size().alias("size"), F.min("root").alias("least"), F.max("root").alias("most"))
                        .where("least <> most").select("key", "size"), "setsketch-mixed")
    return members.join(small(mixed), "key")


def _cells(others: DataFrame, own: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows ``others`` of a key cut into ``tiles`` tiles, and the rows ``own`` into ``outer``
    ones, each of these with each of those; ``cuts`` is a materialised table (key, tiles, outer)."""
    h, cuts = F.xxhash64("class"), small(cuts)

    def upto(c):
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    parts = (others.join(cuts, "key").withColumn("x", upto("outer")).withColumn("y", F.pmod(h, "tiles"))
             .withColumn("own", F.lit(False)).withColumn("other", F.lit(True)),
             own.join(cuts, "key").withColumn("x", F.pmod(h, "outer")).withColumn("y", upto("tiles"))
             .withColumn("own", F.lit(True)).withColumn("other", F.lit(False)))
    # hashes differ by type
    one, two = (p.withColumn("key", F.xxhash64("key", F.col("x").cast("bigint"), F.col("y").cast("bigint"))).select(*_MEMBER) for p in parts)
    return one.unionByName(two)


def _tiles(members: DataFrame) -> DataFrame:
    """Buckets cut into tiles: classes outside the largest component against all classes."""
    counts = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.max("size").alias("size"))
    outer = F.col("size") * (F.col("all") - F.col("top.c")) / F.col("all") / BUCKET
    main = materialise(counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all"), F.max("size").alias("size"))
                       .select("key", F.col("top.root").alias("main"), F.ceil(F.col("size") / BUCKET).cast("int").alias("tiles"),
                               F.ceil(outer).cast("int").alias("outer")), "setsketch-main")
    outside = members.join(small(main.select("key", "main")), "key").where("root <> main").drop("main")
    return _cells(members, outside, main.select("key", "tiles", "outer"))


def _against_large(rooted: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Tiles of each large component (a class a row, however many buckets it is in) against the
    classes outside that share a bucket with it; None without such classes."""
    meet = materialise(rooted.groupBy("key").agg(F.collect_set("large").alias("all"), F.min("root").alias("least"), F.max("root").alias("most"))
                       .where("least <> most").select("key", F.explode("all").alias("of")), "setsketch-meet")
    outside = materialise(rooted.drop("large").join(small(meet), ["key"]).where("root <> of").select("of", "class", "n", "root").distinct(),
                          "setsketch-outside")
    if outside.isEmpty():
        return None
    of = materialise(outside.groupBy("of").agg(F.ceil(_size() / BUCKET).cast("int").alias("outer")), "setsketch-of")
    inside = materialise(rooted.where("large is not null").select("class", "n", "root").distinct()
                         .join(small(of.select(F.col("of").alias("root"))), "root", "left_semi"), "setsketch-inside")
    cuts = (of.withColumnRenamed("of", "key").join(small(materialise(inside.groupBy(F.col("root").alias("key")).agg(
        F.ceil(_size() / BUCKET).cast("int").alias("tiles")), "setsketch-inner")), "key"))
    cuts = materialise(cuts, "setsketch-cuts")
    both = inside.withColumn("key", F.col("root")), outside.withColumnRenamed("of", "key")
    registers = small(sets.select("class", "registers"), SKETCH_ROWS)
    # no band says where a pair is to be compared: it meets in one tile
    rows = [b.join(registers, "class").withColumn("band", F.lit(-1)).withColumn("second", F.lit(-1)) for b in both]
    return _cells(*rows, cuts)


def _second_round(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Rows of groups of classes that have a plausible partner in another component."""
    large = materialise(roots.groupBy("root").agg(F.count("*").alias("c")).where(F.col("c") >= BUCKET).select("root", F.col("root").alias("large")),
                        "setsketch-large")
    rooted = materialise(members.select("key", "band", "class", "n").join(small(roots), F.col("class") == F.col("node"), "left")
                         .select("key", "band", "class", "n", F.coalesce("root", "class").alias("root"))
                         .join(small(large), "root", "left"), "setsketch-rooted")
    found = []
    if not large.isEmpty() and (cells := _against_large(rooted, sets)) is not None:
        found.append(cells)
    rest = rooted.where("large is null").drop("large")
    open_ = materialise(_mixed(rest).join(small(sets.select("class", "registers"), SKETCH_ROWS), "class").withColumn("second", F.lit(-1))
                        .withColumn("own", F.lit(True)).withColumn("other", F.lit(True)), "setsketch-open")
    found.append(open_.where(F.col("size") <= BUCKET))
    crowded = open_.where(F.col("size") > BUCKET).drop("size")
    if not crowded.isEmpty():
        later = F.filter(F.array(*[F.struct(F.lit(j).alias("second"), _band(j).alias("k")) for j in range(BANDS)]),
                         lambda s: s["second"] > F.col("band"))
        again = (crowded.drop("second").withColumn("s", F.explode(later))
                 .select(F.xxhash64("key", "s.second", "s.k").alias("key"), "band", "s.second", "class", "root", "n", "registers", "own", "other"))
        again = materialise(_mixed(again), "setsketch-again")
        found += [again.where(F.col("size") <= BUCKET), _tiles(again.where(F.col("size") > BUCKET))]
    out = _unsettled(found[0], percent)
    for f in found[1:]:
        out = out.unionByName(_unsettled(f, percent))
    return out


def links(sets: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes, at least a spanning forest of every component of
    "at least ``percent`` similar".  ``sets`` is a materialised table (class, n, registers)."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = (sets.repartition(parts, "class")
             .select("class", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), _band(i).alias("key")) for i in range(BANDS)])).alias("s"))
             .select("class", "n", "s.*"))
    shared = materialise(bands.groupBy("key", "band").agg(F.count("*").alias("size"), F.min("class").alias("lead"))
                         .where("size > 1").select("key", "band", "lead"), "setsketch-shared")
    members = materialise(bands.join(small(shared), ["key", "band"]), "setsketch-members")
    # of the least members of its buckets, the one that a class meets most often
    first = (members.where("class <> lead").groupBy("class", "lead").agg(F.count("*").alias("c"))
             .groupBy("class").agg(F.min(F.struct(-F.col("c"), F.col("lead"))).alias("s"))
             .select(F.col("s.lead").alias("a"), F.col("class").alias("b")))
    found = materialise(_verified(materialise(_likely(first, sets, percent), "setsketch-first"), texts, shingle_words, percent), "setsketch-links")
    roots = materialise(connected_components(found), "setsketch-roots")
    rest = materialise(_second_round(members, sets, roots, percent), "setsketch-rest")
    return materialise(found.unionByName(_settled(rest, texts, shingle_words, percent)), "setsketch-all")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 85) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) per document row."""
    prints = materialise(sketches(docs, id_col, text_col, shingle_words).withColumn("row", F.monotonically_increasing_id()), "setsketch-prints")
    classes = materialise(prints.where("n > 0").groupBy("digest").agg(F.min("row").alias("class"), F.min("id").alias("first_id")),
                          "setsketch-classes")
    sets = materialise(prints.join(small(classes.select(F.col("class").alias("row"))), "row").select(F.col("row").alias("class"), "n", "registers"),
                       "setsketch-sets")
    roots = materialise(connected_components(links(sets, prints.select("row", "text"), shingle_words, percent)), "setsketch-components")
    rooted = materialise(classes.join(small(roots), F.col("class") == F.col("node"), "left")
                         .select("digest", "first_id", F.coalesce("root", "class").alias("root")), "setsketch-named")
    least = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "setsketch-least")
    named = materialise(rooted.join(small(least), "root").select("digest", "component_id"), "setsketch-components")
    out = prints.select("id", "n", "digest").join(small(named), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
