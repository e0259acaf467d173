"""WARC records and Merkle fixity audits of their replicas.

Every record of an archive file is hashed over its bytes; the records of an offset range of
``RANGE`` bytes are hashed together in offset order, ``FANOUT`` neighbouring ranges form a node
of the next level, and so on up to one root per archive file.  An audit builds the tree of two
replicas, compares the roots, and descends only into children of nodes that differ; only the
records of ranges that differ are compared one by one.

``archive_index`` lays records out: ordered by their key (ties by digest), ``per_file`` records
a file, each at the byte where the one before ends.  A replica is a table (file, offset,
length, digest) of what stands at each offset.

``audit`` assumes damage in place: records are compared by their offsets.  In a replica laid out
from its own bytes, a lost or shortened record moves all that follow it in its file, and every
one of them is listed as missing, extra or changed; records are not realigned by digest.

Defined cases: null url and html are empty; null ids come first; repeated records are records of
their own; several records at one offset (not a valid archive) are hashed as a sorted list with
their counts; a record that only one side has is ``missing`` or ``extra``, one whose length or
digest differs ``changed``; empty tables have no roots and no differences; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

RANGE, FANOUT = 1 << 16, 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC/1.0 response record; its bytes are this text in UTF-8."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def digest_of(record: Column) -> list[Column]:
    return [F.octet_length(record).cast("bigint").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest")]


def archive_index(records: DataFrame, key: str, per_file: int = 1000) -> DataFrame:
    """``records`` (key, length, digest, more) with (file, offset).  Rows are numbered over
    ranges of the key and the digest, so neither many rows nor a frequent key meet in a task."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written first, as setting the ranges reads the rows once more
    ranged = materialise(materialise(records, "warc-records").repartitionByRange(parts, key, "digest").sortWithinPartitions(key, "digest")
                         .withColumn("_part", F.spark_partition_id())
                         .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "warc-ranged")
    starts = materialise(ranged.groupBy("_part").agg(F.count("*").alias("n"))
                         .selectExpr("_part", "sum(n) over (order by _part) - n as _start"), "warc-starts")
    numbered = ranged.join(small(starts), "_part").withColumn("_n", F.col("_start") + F.col("_row"))
    by_file = Window.partitionBy("file").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    return (numbered.withColumn("file", F.expr(f"_n div {per_file}")).withColumn("offset", F.sum("length").over(by_file) - F.col("length"))
            .drop("_part", "_row", "_start", "_n"))


def _joined_hash(entries: Column) -> Column:
    return F.sha2(F.array_join(entries, "|"), 256)


def _leaves(records: DataFrame, range_bytes: int) -> DataFrame:
    return (records.groupBy("file", "offset", "length", "digest").agg(F.count("*").alias("copies"))
            .withColumn("node", F.expr(f"offset div {range_bytes}"))
            .withColumn("entry", F.concat_ws(":", "offset", "length", "digest", "copies")))


def fixity_tree(records: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT, levels: int | None = None) -> list[DataFrame]:
    """Materialised tables (file, node, hash) per level, offset ranges first, roots last."""
    leaves = _leaves(records, range_bytes)
    level = materialise(leaves.groupBy("file", "node").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "entry"))).alias("e"))
                        .select("file", "node", _joined_hash(F.col("e.entry")).alias("hash")), "warc-level")
    tree = [level]
    if levels is None:
        levels = tree_levels(int(level.agg(F.max("node")).first()[0] or 0), fanout)
    for _ in range(levels - 1):
        above = (tree[-1].groupBy("file", F.expr(f"node div {fanout}").alias("up"))
                 .agg(F.sort_array(F.collect_list(F.struct("node", F.concat_ws(":", "node", "hash").alias("entry")))).alias("e"))
                 .select("file", F.col("up").alias("node"), _joined_hash(F.col("e.entry")).alias("hash")))
        tree.append(materialise(above, "warc-level"))
    return tree


def tree_levels(last_node: int, fanout: int) -> int:
    levels = 1
    while last_node:
        last_node //= fanout
        levels += 1
    return levels


def _differing(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    both = a.withColumnRenamed(value, "va").join(b.withColumnRenamed(value, "vb"), on, "full_outer")
    return both.where(~F.col("va").eqNullSafe(F.col("vb")))


def audit(expected: DataFrame, found: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, status, expected, found) of every record in which the replicas differ;
    the last two are ``length:digest:copies``, or null."""
    sides = [materialise(df.select("file", "offset", "length", "digest"), "warc-side") for df in (expected, found)]
    last = max(int(df.agg(F.max("offset")).first()[0] or 0) for df in sides) // range_bytes
    trees = [fixity_tree(df, range_bytes, fanout, tree_levels(last, fanout)) for df in sides]
    suspects = materialise(_differing(trees[0][-1], trees[1][-1], ["file", "node"], "hash").select("file", "node"), "warc-suspects")
    for level in range(len(trees[0]) - 2, -1, -1):
        above = small(suspects.withColumnRenamed("node", "up"))
        below = [t[level].withColumn("up", F.expr(f"node div {fanout}")).join(above, ["file", "up"], "left_semi").drop("up") for t in trees]
        suspects = materialise(_differing(*below, ["file", "node"], "hash").select("file", "node"), "warc-suspects")
    at = small(suspects)
    records = [_leaves(df.withColumn("node", F.expr(f"offset div {range_bytes}")).join(at, ["file", "node"], "left_semi"), range_bytes)
               .groupBy("file", "offset").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "length", "digest", "copies"))), ",").alias("v"))
               for df in sides]
    return _differing(*records, ["file", "offset"], "v").select(
        "file", "offset", F.when(F.col("vb").isNull(), "missing").when(F.col("va").isNull(), "extra").otherwise("changed").alias("status"),
        F.col("va").alias("expected"), F.col("vb").alias("found"))
