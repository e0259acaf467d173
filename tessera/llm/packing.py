"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest permitted length; the pieces are dealt by
a hash of their identity into shards of about ``SHARD`` pieces, and each shard is packed by
variable-capacity best fit: pieces from long to short, each into the open bin with the least
room that still holds it; if none does, a bin of the size with the least cost per token is
opened, where a size is priced by the tokens that the pieces still to place fill it with, from
long to short.  The permitted lengths are optimised jointly: a shard is packed once for every
subset of them that holds its longest piece, and the cheapest result stays.  At the end every
bin is downsized to the cheapest permitted length that holds its contents.  Costs are per bin of
a length (default: the length plus ``OVERHEAD`` tokens).

Defined cases: rows that repeat an id and length are numbered copies and packed each; a
document without tokens (null text too) gives one row without a bin; null ids are packed like
others; a very long text is many pieces in many shards; pieces of one length go in the order of
id, copy and piece, of equal rooms the bin opened first is filled, of equal prices the shorter
length is opened and of equal packings the first of fewest lengths stays; an empty table gives an empty result; only the id and the length column are used.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import materialise, n_words

#: pieces of a shard on average; the tail of a shard that fills no bin is a vanishing share
SHARD = 4096
OVERHEAD = 32


def best_fit(lengths: list[int], capacities: list[int], cost: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """Places ``lengths`` (descending, none above the largest capacity): the bin and offset of
    each piece and, per bin, its tokens.  ``capacities`` ascend."""
    room_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is an open bin with room r
    left, open_lengths = Counter(lengths), sum(1 << n for n in set(lengths))  # pieces still to place
    fill, bins, offsets = [], [], []

    def price(size: int, n: int) -> float:
        """Cost per token of a bin opened for ``n``."""
        room, fitting = size - n, open_lengths
        while fitting := fitting & ((1 << (room + 1)) - 1):
            m = fitting.bit_length() - 1
            room -= m * min(left[m], room // m)
            fitting ^= 1 << m
        tokens = size - room
        return min(cost[c] for c in capacities if c >= tokens) / tokens

    for n in lengths:
        left[n] -= 1
        if not left[n]:
            open_lengths ^= 1 << n
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            here = heappop(room_bins[room])  # of equal rooms the bin opened first
            if not room_bins[room]:
                rooms ^= 1 << room
        else:
            sizes = [c for c in capacities if c >= n]
            size = min(sizes, key=lambda c: (price(c, n), c)) if len(sizes) > 1 else sizes[0]
            here, room = len(fill), size
            fill.append(0)
        bins.append(here)
        offsets.append(fill[here])
        fill[here] += n
        if room > n:
            heappush(room_bins.setdefault(room - n, []), here)
            rooms |= 1 << (room - n)
    return bins, offsets, fill


def pack_shard(lengths: list[int], capacities: list[int], cost: dict[int, int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The cheapest packing over the permitted subsets: bins, offsets, bin tokens and the
    downsized bin lengths."""
    best = None
    subsets = [s for n in range(1, len(capacities) + 1) for s in combinations(capacities, n)]
    for allowed in subsets:
        if lengths and allowed[-1] < lengths[0]:
            continue
        bins, offsets, fill = best_fit(lengths, allowed, cost)
        sizes = [min((c for c in capacities if c >= f), key=lambda c: (cost[c], c)) for f in fill]
        total = sum(cost[s] for s in sizes)
        if best is None or total < best[0]:
            best = total, bins, offsets, fill, sizes
    return best[1:]


def pack(docs: DataFrame, capacities: list[int], costs: dict[int, int] | None = None, id_col: str = "doc_id",
         length: Column | None = None, seed: int = 0, shard_pieces: int = SHARD) -> DataFrame:
    """(id, copy, piece, start, length, shard, bin, bin_offset, bin_length, bin_tokens): where
    every piece ``[start, start + length)`` of every document goes; ``bin`` is unique."""
    sizes = sorted(set(capacities))
    cost = costs or {c: c + OVERHEAD for c in sizes}
    length = n_words(F.col("text")) if length is None else length
    kind = docs.schema[id_col].dataType.simpleString()
    longest = sizes[-1]
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint")).alias("n"))
                       .groupBy("id", "n").agg(F.count("*").alias("copies")), "pack-rows")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    n_pieces = int(rows.agg(F.sum(F.col("copies") * F.ceil(F.col("n") / longest))).first()[0] or 0)
    shards = max(1, -(-n_pieces // shard_pieces))
    pieces = (copies.where("n > 0")
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {longest}"))))
              .select("id", "copy", "piece", (F.col("piece") * longest).alias("start"),
                      F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("length"))
              .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "copy", "piece"), F.lit(shards))))
    schema = (f"id {kind}, copy bigint, piece bigint, start bigint, length int, shard bigint, bin bigint, bin_offset int, "
              "bin_length int, bin_tokens int")
    ship_package(docs.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("length", "descending"), ("id", "ascending"), ("copy", "ascending"),
                                                   ("piece", "ascending")]))
        bins, offsets, fill, lengths = pack_shard(table["length"].to_pylist(), sizes, cost)
        bins = np.array(bins)
        new = {"bin": (table["shard"].to_numpy() << 24) + bins, "bin_offset": np.array(offsets, np.int32),
               "bin_length": np.array(lengths, np.int32)[bins], "bin_tokens": np.array(fill, np.int32)[bins]}
        for name, values in new.items():
            table = table.append_column(name, pa.array(values))
        return table

    packed = pieces.groupBy("shard").applyInArrow(run, schema)
    empty = copies.where("n = 0").select("id", "copy", *[F.lit(None).cast("bigint").alias(c) for c in ("piece", "start")],
                                         F.lit(0).alias("length"), *[F.lit(None).cast("bigint").alias(c) for c in ("shard", "bin")],
                                         *[F.lit(None).cast("int").alias(c) for c in ("bin_offset", "bin_length", "bin_tokens")])
    return packed.unionByName(empty)
