"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers.

Two first-order character models, of random strings and of ordinary identifiers, are trained on
labelled samples; a long run of key characters whose log-likelihood ratio (random against
ordinary) is large in total and per character is reported as a ``markov`` span.  Spans of the
fixed patterns cut a run; each part is scored as a whole and, if that isn't large, by its
best-scoring stretches between separators, so a key glued to words or to another key is found.
Spans are code point offsets, end exclusive.

``labelled_samples`` draws the labels from the given table: ordinary samples are the words of at
most ``SAMPLE_DOCUMENTS`` documents (smallest id hashes) outside the fixed patterns' spans;
random samples are digests of those documents' ids in several alphabets.

Defined cases: a null text counts as empty and has no spans; very long texts are scanned whole,
in time that grows with their runs and spans; repeated rows are scanned each; an empty table has
no samples, and a model without samples finds nothing; other columns, whatever their names, are
ignored or kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, map_slices

SAMPLE_DOCUMENTS = 2000
#: characters of a run that is scored, and the least log-likelihood ratio (nats), whole and per character
MIN_RUN, MIN_RATIO, MIN_PER_CHARACTER = 16, 14.0, 0.5
KINDS = ("assign", "access", "hex", "markov")
# fixed patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# a match of the access or hex pattern lies within such a run; the markov runs have no dots
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = {c: i for i, c in enumerate(_ALPHABET)}
_START = len(_ALPHABET)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, in no particular order."""
    spans = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for run in _RUN.finditer(text):
        at, part = run.start(), run.group()
        spans += [("access", at + m.start(), at + m.end()) for m in _ACCESS.finditer(part) if m.end() - m.start() >= 16]
        spans += [("hex", at + m.start(), at + m.end()) for m in _HEX.finditer(part)]
    return spans


def _outside(runs, taken: list[tuple[str, int, int]]):
    """The parts of ascending runs (start, stop) that lie outside the taken spans, both lists
    walked once."""
    cover: list[list[int]] = []
    for start, stop in sorted((s, e) for _, s, e in taken):
        if cover and start <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], stop)
        else:
            cover.append([start, stop])
    i = 0
    for at, end in runs:
        while i < len(cover) and cover[i][1] <= at:
            i += 1
        j = i
        while j < len(cover) and cover[j][0] < end:
            if at < cover[j][0]:
                yield at, cover[j][0]
            at = max(at, cover[j][1])
            j += 1
        if at < end:
            yield at, end


class MarkovModel:
    """``ratio[a, b]``: log-likelihood ratio of character b after a; None if a class has no samples."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        if random.sum() and ordinary.sum():
            self.ratio = (np.log(self._smooth(random)) - np.log(self._smooth(ordinary))).tolist()
        else:
            self.ratio = None

    @staticmethod
    def _smooth(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
        """Transition shares, drawn towards the character's overall share where samples are few."""
        overall = counts.sum(axis=0) + 0.5
        return (counts + weight * overall / overall.sum()) / (counts.sum(axis=1, keepdims=True) + weight)

    def spans(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        if self.ratio is None:
            return []
        return [("markov", a, b) for lo, hi in _outside((m.span() for m in _RUN.finditer(text)), taken)
                for a, b in self._part(text, lo, hi)]

    def _part(self, text: str, at: int, end: int) -> list[tuple[int, int]]:
        """The spans of key characters ``text[at:end]``: the whole, or its best stretches."""
        if end - at < MIN_RUN:
            return []
        part = text[at:end]
        codes = [_CODE[c] for c in part]
        sums, before = [0.0], _START
        for c in codes:
            sums.append(sums[-1] + self.ratio[before][c])
            before = c
        # a stretch is scored as if it stood alone
        own = [sums[i + 1] - self.ratio[_START][c] for i, c in enumerate(codes)]

        def large(a, b):
            ratio = sums[b] - own[a]
            return (b - a >= MIN_RUN and ratio >= MIN_RATIO and ratio >= MIN_PER_CHARACTER * (b - a)
                    and sum(map(str.isalpha, part[a:b])) >= 4)

        if large(0, len(part)):
            return [(at, end)]
        # stretches begin after and end before separators
        pieces = [m.span() for m in _PIECE.finditer(part)]
        found, rest = [], [(0, len(pieces))]
        while rest:
            low, high = rest.pop()
            best = None
            for lo, hi in self._stretches(pieces, low, high, sums, own):
                a, b = pieces[lo][0], pieces[hi][1]
                if large(a, b) and (best is None or sums[b] - own[a] > best[0]):
                    best = sums[b] - own[a], lo, hi
            if best:
                found.append((at + pieces[best[1]][0], at + pieces[best[2]][1]))
                rest += [(low, best[1]), (best[2] + 1, high)]
        return found

    @staticmethod
    def _stretches(pieces, low: int, high: int, sums, own):
        """First and last pieces of the stretches to try: every piece, and of the stretches that
        end with a piece the ones of greatest ratio, in total and above the least per character."""
        for least in (0.0, MIN_PER_CHARACTER):
            best, first = None, low
            for hi in range(low, high):
                while first <= hi and pieces[hi][1] - pieces[first][0] >= MIN_RUN:
                    a = pieces[first][0]
                    if best is None or own[a] - least * a < own[pieces[best][0]] - least * pieces[best][0]:
                        best = first
                    first += 1
                if best is not None:
                    yield best, hi
        yield from ((i, i) for i in range(low, high))


def _transitions(words) -> Counter:
    pairs = Counter()
    for word in words:
        before = _START
        for c in map(_CODE.__getitem__, word):
            pairs[before, c] += 1
            before = c
    return pairs


def _digests(key: str) -> list[str]:
    """Random strings of one id: hexadecimal, base 64 (both alphabets), base 32 and letters with digits."""
    raw = [hashlib.sha256(f"{key}:{i}".encode()).digest() for i in range(4)]
    plain = base64.b64encode(raw[1]).decode()
    return [raw[0].hex(), plain.rstrip("="), base64.urlsafe_b64encode(raw[2]).decode().rstrip("="),
            base64.b32encode(raw[3]).decode().rstrip("="), plain.replace("+", "").replace("/", "").rstrip("=")]


_WORD_RUN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """(sample, random) strings with their label, from at most ``max_documents`` ids."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_documents)

    def run(batches):
        for b in batches:
            ordinary, random = [], []
            for key, text in zip(b["id"], b["text"]):
                text = text or ""
                taken = base_spans(text)
                # runs that no span touches
                whole = {m.span() for m in _WORD_RUN.finditer(text)}
                ordinary += [text[a:b] for a, b in _outside(sorted(whole), taken) if (a, b) in whole]
                random += _digests(str(key))
            yield {"sample": ordinary + random, "random": [False] * len(ordinary) + [True] * len(random)}

    # at most max_documents ids by construction
    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id"), run,
                    "sample string, random boolean")


def fit_markov(samples: DataFrame) -> MarkovModel:
    """Counts the transitions of labelled samples (sample, random); the counts are bounded by
    the alphabet, whatever the number of samples."""
    def run(batches):
        pairs = {False: Counter(), True: Counter()}
        for b in batches:
            for label in pairs:
                pairs[label] += _transitions("".join(c for c in s if c in _CODE) for s, r in zip(b["sample"], b["random"])
                                             if s and r is label)
        flat = [(label, *pair, n) for label in pairs for pair, n in pairs[label].items()]
        yield dict(zip(("random", "a", "b", "n"), map(list, zip(*flat)))) if flat else {"random": [], "a": [], "b": [], "n": []}

    counts = {label: np.zeros((_START + 1, _START)) for label in (False, True)}
    for r in (map_rows(samples.select("sample", "random"), run, "random boolean, a int, b int, n bigint")
              .groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect()):
        counts[r["random"]][r["a"], r["b"]] = r["n"]
    return MarkovModel(counts[True], counts[False])


def all_spans(text: str | None, model: MarkovModel) -> list[tuple[str, int, int]]:
    """Every span, by start, then kind as listed in ``KINDS``."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + model.spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, model: MarkovModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per document row, spans as an array of structs (kind, start, stop)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield {"id": b["id"], "spans": [[{"kind": k, "start": s, "stop": e} for k, s, e in all_spans(t, model)]
                                            for t in b["text"]]}

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run,
                    f"id {kind}, spans array<struct<kind: string, start: bigint, stop: bigint>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span (overlapping ones together) replaced by ``mark``; a text
    without spans, null texts included, and all other columns are unchanged."""
    model = fit_markov(labelled_samples(docs))

    def clean(text: str | None) -> str | None:
        spans = all_spans(text, model)
        if not spans:
            return text
        parts, at = [], 0
        for _, start, end in spans:
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def masked(b: pa.RecordBatch, place: int) -> pa.RecordBatch:
        texts = pa.array([clean(t) for t in b.column(place).to_pylist()], b.schema.field(place).type)
        return pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(b.columns)], schema=b.schema)

    return map_slices(docs, "text", masked)
