"""SimHash near duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into few enough segments that two fingerprints within the maximum
distance differ by at most one bit in some segment (two 32-bit segments for distances up to 3).
Each segment is indexed under its one-wildcard variants (one bit cleared, the position noted),
so two such fingerprints meet in an equality match on a variant and are then verified by the
full Hamming distance.

Only distinct fingerprints are indexed: copies share one.  A variant shared by two fingerprints
is settled from the combinable minimum and maximum of its bucket; a bucket of up to
``BUCKET`` fingerprints is verified in one task, which emits a spanning forest of its links and
never its pairs; the fingerprints of larger buckets are grouped by all patterns with
``max_distance`` wildcard bits, where sharing a pattern is itself the proof of the distance and
a group has at most ``2 ** max_distance`` members.  No link is lost on any of the three ways.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is
linked like any other; repeated rows are copies of each other; a null ``doc_id`` takes part but
never names a component (a component without any id gets a null ``component_id``); an empty
table gives an empty result; columns besides the id and text columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import row_hash
from .common import map_rows, materialise, small

#: fingerprints of one variant bucket that are verified in a single task
BUCKET = 512
_SHINGLES_AT_ONCE = 65_536


def text_fingerprint(text: str | None, shingle_words: int) -> int:
    """Unsigned 64-bit SimHash of the XXH64 (seed 42) values of the word shingles."""
    from xxhash import xxh64_intdigest

    # on bytes, lower() touches A-Z only and split() knows just the six ASCII blanks
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    span = min(shingle_words, len(words)) - 1
    starts = (ends - lengths)[: len(words) - span].tolist()
    ends = ends[span:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = slice(at, at + _SHINGLES_AT_ONCE)
        values = np.fromiter((xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts[part], ends[part])),
                             ">u8", len(starts[part]))
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, fp) per document row, with the columns ``keep`` (named neither id nor fp nor
    text); ``fp`` holds the 64 bits as a signed long."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}

    def run(batches):
        for b in batches:
            yield {"id": b["id"], "fp": [_signed(text_fingerprint(t, shingle_words)) for t in b["text"]]} | {c: b[c] for c in keep}

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep), run,
                    ", ".join([f"id {kinds[id_col]}, fp bigint", *(f"{c} {kinds[c]}" for c in keep)]))


def _variants(classes: DataFrame, max_distance: int) -> DataFrame:
    """(fp, key) for every segment and wildcard position."""
    segments = max(2, max_distance // 2 + 1)
    cuts = [64 * i // segments for i in range(segments + 1)]
    keys = []
    for lo, hi in zip(cuts, cuts[1:]):
        value = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        for bit in range(hi - lo):
            keys.append(value.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((lo + bit) << 32)))
    return classes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _bucket_forest(max_distance: int):
    """Links of one bucket reduced to a spanning forest."""
    def run(batches):
        for b in batches:
            left, right = [], []
            for members in b["members"]:
                bits = np.array(sorted(members), np.int64)
                root = np.arange(len(bits))
                for i in range(1, len(bits)):
                    near = np.flatnonzero(np.bitwise_count((bits[:i] ^ bits[i]).view(np.uint64)) <= max_distance)
                    fresh, first = np.unique(root[near], return_index=True)
                    for j in near[first]:
                        left.append(int(bits[j]))
                        right.append(int(bits[i]))
                    if len(fresh):
                        root[np.isin(root, fresh)] = i
                        root[i] = i
            yield {"a": left, "b": right}
    return run


def fingerprint_links(classes: DataFrame, max_distance: int = 2) -> DataFrame:
    """Links (a < b) between distinct fingerprints, at least a spanning forest of every
    component of the relation "Hamming distance at most ``max_distance``".  ``classes`` is a
    materialised table with one row per fingerprint ``fp``."""
    if not 0 <= max_distance <= 3:
        raise ValueError("max_distance must be 0 to 3")
    # dealt out after the reread, whose scan packs small files: each row becomes some 64 variants
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = _variants(classes.repartition(parts, "fp"), max_distance)
    shared = materialise(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                         .where("n > 1"), "simhash-shared")
    pairs = shared.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance).select("a", "b")
    members = materialise(variants.join(small(shared.where("n > 2").select("key", "n")), "key"), "simhash-members")
    middle = map_rows(members.where(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("members"))
                      .select("members"), _bucket_forest(max_distance), "a bigint, b bigint")
    masks = [sum(1 << x for x in bits) for bits in combinations(range(64), max_distance)]
    patterns = F.array(*[F.lit(_signed(((1 << 64) - 1) ^ m)) for m in masks])
    large = (members.where(F.col("n") > BUCKET).select("fp").distinct()
             .select("fp", F.explode(patterns).alias("mask"))
             .groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
             .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members")).where(F.size("members") > 1)
             .select("a", F.explode("members").alias("b")).where("a <> b"))
    return materialise(pairs.unionByName(middle).unionByName(large).distinct(), "simhash-links")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, the root being the smallest node of its component:
    alternating large-star and small-star steps until the links no longer change.  ``links``
    is a materialised table of pairs (a, b)."""
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = small(materialise(both.groupBy("a").agg(F.min("b").alias("m")), "cc-least"))
        large = materialise(both.join(least, "a").where("b > a")
                            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "cc-large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        links = materialise(large.join(small(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc-links")
        after = state(links)
        if after == before:
            break
        before = after
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                    max_distance: int = 2) -> DataFrame:
    """One row (id, fp, component_id) per document row, in which ``component_id`` is the
    smallest id that the links reach."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    return prints.join(_named(prints, max_distance), "fp").select("id", "fp", "component_id")


def _named(prints: DataFrame, max_distance: int) -> DataFrame:
    """The materialised table (fp, component, component_id) of the fingerprints of the
    materialised ``prints``; ``component`` is the smallest fingerprint that the links reach."""
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    roots = materialise(connected_components(fingerprint_links(classes, max_distance)), "simhash-roots")
    rooted = materialise(classes.join(small(roots), classes["fp"] == roots["node"], "left")
                         .select("fp", "first_id", "root"), "simhash-rooted")
    firsts = materialise(rooted.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id")),
                         "simhash-firsts")
    return materialise(rooted.join(small(firsts), "root", "left")
                       .select("fp", F.coalesce("root", "fp").alias("component"),
                               F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id")),
                       "simhash-named")


def keep_one(docs: DataFrame, shingle_words: int = 3, max_distance: int = 2, null_ids_stay: bool = True) -> DataFrame:
    """The documents with one row of each near-duplicate group: the one that is least by
    ``doc_id`` (null last), fingerprint, a hash of its columns and its place; of equal rows, one.
    An id that several groups have names a row in each.  With ``null_ids_stay``, rows without an id
    all stay, and only rows with one are reduced.  Columns are returned unchanged, whatever their
    names and types."""
    # numbered once, when they are written: the numbers then name the same rows in every stage
    rows = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_hash(docs).alias("hash"),
                                   F.monotonically_increasing_id().alias("row")), "simhash-rows")
    prints = materialise(fingerprints(rows.select("doc.doc_id", "doc.text", "hash", "row"), shingle_words=shingle_words, keep=("hash", "row")),
                         "simhash-prints")
    named = _named(prints, max_distance)
    if null_ids_stay:
        prints = prints.where("id is not null")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "hash", "row")).alias("least")
    # first per fingerprint, so that copies are few before the join
    firsts = materialise(prints.groupBy("fp").agg(least), "simhash-least")
    keep = materialise(firsts.join(small(named.select("fp", "component")), "fp").groupBy("component").agg(F.min("least").alias("least"))
                       .select("least.row"), "simhash-keep")
    stay = rows.join(small(keep), "row", "left_semi").select("doc.*")
    return stay.unionByName(rows.where("doc.doc_id is null").select("doc.*")) if null_ids_stay else stay
