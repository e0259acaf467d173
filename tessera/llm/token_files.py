"""Token-id files: canonical length-limited Huffman blocks with bit-offset checkpoints.

A file set is a folder of three Parquet tables: ``codebook`` (id, length), ``blocks`` (part,
block, tokens, doc ids and lengths, checkpoints, payload) and ``parts`` (part, start).  The code
lengths come from the global counts of the ids by package-merge, limited to ``MAX_BITS``; codes
are canonical (by length, then id), so the lengths alone restore them.  Documents are ordered by
id over all parts and blocks; a block holds whole documents, closes once it has ``BLOCK`` ids
and is decoded on its own.  Every ``EVERY`` ids a checkpoint notes the bit offset: decoding
looks up ``MAX_BITS`` bits at a time in one table and runs all checkpoints of a block side by
side.

``encode_words`` serves tokenizers that drop white space, ignore case and encode words one by
one: words repeat, so a task encodes each piece of a text once.

Defined cases: a null text is empty and has just the end id; null document ids come first;
rows that repeat an id stay rows, in the order of their ids' checksum and number; an empty table
gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_rows, materialise, small

MAX_BITS = 20
BLOCK, EVERY = 1 << 19, 256
#: ids of a part on average, at most
PART = 1 << 26
#: pieces of texts whose ids a worker process keeps
CACHE = 700_000
#: bytes of text encoded at once, but for the rest of the last text
LOT = 1 << 23


# ----------------------------------------------------------------- tokenising

#: a piece of Latin-1 letters is one word to the tokenizer; plain punctuation after such a letter begins the next
_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+")


def _marked(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_BLANK, _PUNCTUATION, _LOWER = _marked(b" \t\n\r\x0b\x0c"), _marked(b".,;:!?|%&$#*"), _marked(bytes(range(97, 123)))
#: second UTF-8 bytes, after 0xC3, of the Latin-1 letters beyond ASCII
_LATIN = _marked(bytes([*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]))
_ASCII_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def cut_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one after another, and each text's first piece (one number more
    than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets, raw = offsets - offsets[0], _ASCII_LOWER[raw]
    inside = ~_BLANK[raw]
    letter = _LOWER[raw]
    letter[1:] |= (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (_PUNCTUATION[raw[1:]] & letter[:-1])
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    data = raw[inside]
    stops = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, len(data)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(stops), pa.py_buffer(data)])
    return pieces, np.searchsorted(at, offsets)


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, piece by piece.

    Pieces are runs between ASCII blanks, in ASCII lower case, cut once more between a Latin-1
    letter and the plain punctuation after it, where the tokenizer starts a new word anyway.
    Pieces of letters go to the tokenizer's model in bulk, in lower case and cut at blanks, and
    their ids are told apart by the suffix that ends a word; others are encoded alone.  A text that may hold a
    special token's string is encoded as it stands.  Known pieces are kept as arrays.
    """

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer, self.plain = Tokenizer.from_str(config), Tokenizer.from_str(config)
        self.plain.normalizer, self.plain.pre_tokenizer = Sequence([]), WhitespaceSplit()
        # what the model reads for a letter beyond ASCII
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        parsed = json.loads(config)
        suffix = parsed["model"].get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in parsed["added_tokens"]]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.ids = pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.sizes = np.zeros(0, np.int64)

    def _alone(self, piece: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4")

    def _learn(self, fresh: pa.Array) -> None:
        """Adds pieces; none of them is known."""
        text = [raw.decode("utf-8") for raw in fresh.to_pylist()]
        is_word = np.fromiter((_LETTERS.fullmatch(t) is not None for t in text), bool, len(text))
        words = [t if t.isascii() else t.lower().translate(self.byte_chars) for t, w in zip(text, is_word.tolist()) if w]
        sizes = np.zeros(len(text), np.int64)
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids if words else [], "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or len(stops) and stops[-1] != len(ids):
            is_word[:], words, ids, stops = False, [], ids[:0], stops[:0]
        sizes[is_word] = np.diff(stops, prepend=0)
        others = [self._alone(t) for t, w in zip(text, is_word) if not w]
        sizes[~is_word] = [len(x) for x in others]
        # letters first, then the others
        order = np.argsort(~is_word, kind="stable")
        self.pieces = pa.concat_arrays([self.pieces, fresh.take(pa.array(order))])
        self.sizes = np.concatenate([self.sizes, sizes[order]])
        self.ids = np.concatenate([self.ids, ids, *others])

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = texts.fill_null("")
        cut, first = cut_pieces(texts)
        code = pc.index_in(cut, self.pieces)
        if code.null_count:
            missed = code.is_null()
            fresh = cut.filter(missed).unique()
            if len(self.pieces) + len(fresh) > CACHE:
                self._forget()
                fresh = cut.unique()
                missed = pa.array(np.ones(len(cut), bool))
            known = len(self.pieces)
            self._learn(fresh)
            code = code.to_numpy(zero_copy_only=False)
            missed = missed.to_numpy(zero_copy_only=False)
            code[missed] = pc.index_in(cut.filter(pa.array(missed)), self.pieces.slice(known)).to_numpy() + known
            code = code.astype(np.int32)
        else:
            code = code.to_numpy()
        # the ids of all texts: every place of a piece copies the piece's ids
        starts, size = np.cumsum(self.sizes) - self.sizes, self.sizes[code]
        stops = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(starts[code] - stops[:-1], size) + np.arange(stops[-1])]
        at = stops[first].tolist()
        out = [ids[s:e].tobytes() for s, e in zip(at, at[1:])]
        for i in np.flatnonzero(self._suspect(texts)).tolist():
            text = texts[i].as_py()
            if any(x in text.lower() for x in self.special):
                out[i] = self._alone(text).tobytes()
        return out

    def _suspect(self, texts: pa.Array) -> np.ndarray:
        """Texts that share the first character of a special token, as far as those aren't letters."""
        heads = {x[0] for x in self.special}
        if any(h.isalnum() for h in heads):
            return np.ones(len(texts), bool)
        masks = [pc.match_substring(texts, h).to_numpy(zero_copy_only=False) for h in heads]
        return np.logical_or.reduce(masks) if masks else np.zeros(len(texts), bool)


@lru_cache(maxsize=1)
def _encoder(config: str) -> WordEncoder:
    """A worker process keeps its encoder, with the pieces it knows, from task to task."""
    return WordEncoder(config)


def encode_words(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, crc, ids) per row; ``ids`` are packed 16- or 32-bit ids, the end id last,
    ``crc`` is the CRC-32 of the ids as little-endian 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one tokenizer file
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(shared.value)
        for whole in batches:
            for b in _slices(whole):
                raw = [x + end for x in encoder.encode(b.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                     pa.array([pack_ids(np.frombuffer(x, "<u4")) for x in raw], pa.binary())], ["id", "n_tokens", "crc", "ids"])

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, crc bigint, ids binary")


def _slices(batch: pa.RecordBatch):
    """The rows a lot of about ``LOT`` bytes of text at a time; a longer text is a lot of its own."""
    size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy()
    lot, at = np.cumsum(size) // LOT, 0
    for stop in [*(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]:
        if stop > at:
            yield batch.slice(at, stop - at)
        at = stop


def pack_ids(ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([wide]) + zstandard.compress(ids.astype("<u4" if wide else "<u2").tobytes(), 1)


def unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed[1:]), "<u4" if packed[0] else "<u2").astype(np.int64)


# ----------------------------------------------------------------- the code

def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts (package-merge)."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < n)  # which of the ordered entries are single ids
        merged = weights[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        own = int(single[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes from (id, length) pairs."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        steps = 1 << (self.bits - self.lengths)
        first = np.concatenate([[0], np.cumsum(steps)[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.codes = first >> (self.bits - self.lengths)
        self._steps = steps

    def for_encoding(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths) by id."""
        codes, lengths = (np.zeros(int(self.ids.max(initial=0)) + 1, np.uint64) for _ in range(2))
        codes[self.ids], lengths[self.ids] = self.codes, self.lengths
        return codes, lengths.astype(np.int64)

    def for_decoding(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(id, length) by the next ``bits`` bits."""
        return np.repeat(self.ids, self._steps), np.repeat(self.lengths, self._steps), self.bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = EVERY) -> tuple[bytes, list[int]]:
    """The payload and the bit offset of every ``every``-th id."""
    size = lengths[ids]
    stop = np.cumsum(size)
    start = stop - size
    word, value = start >> 5, codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
    n = (int(stop[-1]) + 31 >> 5) + 2 if len(ids) else 2
    # bits of different ids never overlap, so sums of the 32-bit halves are exact
    flat = (np.bincount(word, (value >> np.uint64(32)).astype(float), n)
            + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), n))
    return flat.astype(">u4").tobytes(), start[::every].tolist()


def decode_block(payload: bytes, checkpoints: list[int], n: int, table: tuple[np.ndarray, np.ndarray, int], every: int = EVERY) -> np.ndarray:
    symbols, lengths, bits = table
    flat = np.frombuffer(payload, ">u4").astype(np.uint64)
    pairs = (flat[:-1] << np.uint64(32)) | flat[1:]
    at, out = np.array(checkpoints, np.int64), np.zeros((len(checkpoints), every), np.int64)
    mask, last = (1 << bits) - 1, len(pairs) - 1
    for i in range(min(every, n)):
        lanes = len(at) if (len(at) - 1) * every + i < n else len(at) - 1  # the last lane may be short
        a = at[:lanes]
        window = (pairs[np.minimum(a >> 5, last)] >> (64 - bits - (a & 31)).astype(np.uint64)).astype(np.int64) & mask
        out[:lanes, i] = symbols[window]
        at[:lanes] += lengths[window]
    return out.reshape(-1)[:n]


# ----------------------------------------------------------------- files

def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, n) over the whole table."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for packed in b["ids"]:
                own = np.bincount(unpack_ids(packed))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        at = np.flatnonzero(total)
        yield {"id": at.tolist(), "n": total[at].tolist()}

    return map_rows(encoded.select("ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(encoded: DataFrame, path: str, max_bits: int = MAX_BITS, block: int = BLOCK) -> None:
    """Writes a file set from a materialised table (id, n_tokens, crc, ids)."""
    spark = encoded.sparkSession
    counted = count_ids(encoded).toPandas().sort_values("id")  # one row per id of the vocabulary
    ids, n = counted["id"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    book = Codebook(ids, code_lengths(n, max_bits))
    spark.createDataFrame([(int(i), int(x)) for i, x in zip(book.ids, book.lengths)], "id bigint, length int").coalesce(1) \
        .write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(book.for_encoding())
    kind = encoded.schema["id"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n.sum()) // PART))
    ordered = encoded.repartitionByRange(parts, "id", "crc", "n_tokens").sortWithinPartitions("id", "crc", "n_tokens")
    schema = ("part int, block int, n_tokens bigint, doc_ids array<" + kind + ">, doc_tokens array<bigint>, "
              "checkpoints array<bigint>, payload binary")

    def run(batches):
        from pyspark import TaskContext

        codes, lengths = shared.value
        part, number, held, docs, sizes, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def close():
            payload, checkpoints = encode_block(np.concatenate(held), codes, lengths)
            return {"part": [part], "block": [number], "n_tokens": [size], "doc_ids": [docs], "doc_tokens": [sizes],
                    "checkpoints": [checkpoints], "payload": [payload]}

        for b in batches:
            for doc, tokens, packed in zip(b["id"], b["n_tokens"], b["ids"]):
                held.append(unpack_ids(packed))
                docs.append(doc)
                sizes.append(tokens)
                size += tokens
                if size >= block:
                    yield close()
                    number, held, docs, sizes, size = number + 1, [], [], [], 0
        if docs:
            yield close()

    map_rows(ordered.select("id", "n_tokens", "ids"), run, schema).write.parquet(f"{path}/blocks")
    # one row per part: the ids of all earlier parts
    totals = sorted(spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens")).collect())
    starts = np.concatenate([[0], np.cumsum([t for _, t in totals])]).tolist()
    spark.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, starts)], "part int, start bigint").coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) per document, decoded from the files; ``ids`` is an array."""
    return _decoded(spark, path, lambda ids: ids.tolist(), "array<bigint>", "ids")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, crc) per document, decoded from the files."""
    return _decoded(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "bigint", "crc")


def _decoded(spark: SparkSession, path: str, make, result: str, name: str) -> DataFrame:
    ship_package(spark)
    book = spark.read.parquet(f"{path}/codebook").toPandas()  # one row per id of the vocabulary
    shared = spark.sparkContext.broadcast(Codebook(book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64)).for_decoding())
    blocks = spark.read.parquet(f"{path}/blocks")
    # a block's place: its part's start and the tokens of the part's earlier blocks
    places = materialise(blocks.select("part", "block", "n_tokens").join(small(spark.read.parquet(f"{path}/parts")), "part")
                         .selectExpr("part", "block", "start + sum(n_tokens) over (partition by part order by block) - n_tokens as start"),
                         "token-places")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for docs, sizes, checkpoints, payload, n, at in zip(b["doc_ids"], b["doc_tokens"], b["checkpoints"], b["payload"], b["n_tokens"], b["start"]):
                ids = decode_block(payload, checkpoints, n, shared.value)
                stops = np.cumsum(sizes)
                starts = stops - sizes
                yield {"id": docs, "start": (starts + at).tolist(), "n_tokens": sizes,
                       name: [make(ids[s:e]) for s, e in zip(starts.tolist(), stops.tolist())]}

    return map_rows(blocks.join(small(places), ["part", "block"]), run, f"id {kind}, start bigint, n_tokens bigint, {name} {result}")
