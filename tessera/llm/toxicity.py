"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A document's features are its lower-cased words and their 3- and 4-letter beginnings, of which
the model keeps those whose document frequencies among toxic and other labelled documents
differ most (likelihood-ratio statistic).  A feature's value is the square root of its share of
the words.  The model has one weight vector shared by all ordered thresholds:
``P(grade >= k) = sigmoid(w . x - theta_k)`` with ``theta_1 < theta_2 < ...``; the expected
severity is the sum of these probabilities and a document counts as toxic from ``TOXIC`` on.

Labels say toxic or not; the grade of a toxic training document (1 to 3) follows from the share
of its words that carry a toxic feature (``GRADE_EDGES``).  The model is fitted on at most
``max_rows`` labelled documents, those with the smallest hash of their id; every document is
scored, over its whole text.

Defined cases: null or wordless texts have no features (their severity is that of the
thresholds alone); very long texts are scored whole; null labels and ids don't train; an id
labelled twice takes its larger label, an id with several rows trains once; repeated rows are
scored each; features that tie go by name; without labels of both kinds every severity is 0; an
empty table gives an empty result; other columns, whatever their names, are ignored or kept.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, map_slices, materialise

TRAINING_ROWS = 10_000
MAX_FEATURES = 4096
MIN_DOCUMENTS = 3
#: likelihood-ratio statistic from which a feature counts (one in some 200 by chance)
MIN_STATISTIC = 8.0
GRADE_EDGES = (0.02, 0.04)
TOXIC = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")


def _counts(text: str | None) -> Counter:
    return Counter(_LETTERS.findall((text or "").lower()))


def _features(word: str) -> tuple[str, str, str]:
    return word, "3:" + word[:3], "4:" + word[:4]


class SeverityModel:
    """``weights``: feature to weight; ``markers``: the features of toxic documents."""

    def __init__(self, weights: dict[str, float], thresholds: list[float], markers: frozenset = frozenset()):
        self.weights, self.thresholds, self.markers = weights, thresholds, markers
        self._known: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> tuple[str, ...]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 100_000:
                self._known.clear()
            found = self._known[word] = tuple(f for f in _features(word) if f in self.weights)
        return found

    def vector(self, text: str | None) -> tuple[dict[str, float], float]:
        """The feature values, and the share of words with a marker."""
        counts = _counts(text)
        total, own, marked = sum(counts.values()), Counter(), 0
        for word, n in counts.items():
            if found := self._of(word):
                for f in found:
                    own[f] += n
                marked += n * any(f in self.markers for f in found)
        return {f: (n / total) ** 0.5 for f, n in own.items()}, marked / max(total, 1)

    def severity(self, text: str | None) -> float:
        if not self.thresholds:
            return 0.0
        z = sum(self.weights[f] * x for f, x in sorted(self.vector(text)[0].items()))
        return float(sum(1 / (1 + np.exp(np.clip(t - z, -60, 60))) for t in self.thresholds))


def fit_ordinal(rows: list[dict[int, float]], grades: list[int], n_features: int, n_grades: int,
                steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that minimise the mean negative log-likelihood (Adam)."""
    y = np.array(grades)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    val = np.array([v for r in rows for v in r.values()], float)
    start = np.log(max((y == 0).mean(), 1e-3) / max((y > 0).mean(), 1e-3))
    p = np.concatenate([np.zeros(n_features), [start], np.zeros(n_grades - 2)])
    m, v, at = np.zeros_like(p), np.zeros_like(p), np.arange(len(y))
    for step in range(1, steps + 1):
        w, theta = p[:n_features], np.cumsum(np.concatenate([p[n_features:n_features + 1], np.exp(p[n_features + 1:])]))
        z = np.bincount(row, val * w[col], len(y))
        s = np.column_stack([np.ones(len(y)), 1 / (1 + np.exp(np.clip(theta - z[:, None], -60, 60))), np.zeros(len(y))])
        low, high = s[at, y], s[at, y + 1]
        share = np.maximum(low - high, 1e-12)
        dz = -(1 - low - high) / len(y)
        dtheta = np.zeros(n_grades - 1)
        for k in range(1, n_grades):
            slope = s[:, k] * (1 - s[:, k]) / share / len(y)
            dtheta[k - 1] = slope[y == k].sum() - slope[y == k - 1].sum()
        tail = np.cumsum(dtheta[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, val * dz[row], n_features) + ridge * w, tail[:1],
                               tail[1:] * np.exp(p[n_features + 1:]) + ridge * p[n_features + 1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:n_features], np.cumsum(np.concatenate([p[n_features:n_features + 1], np.exp(p[n_features + 1:])]))


def _statistic(n_toxic: int, n_other: int) -> Column:
    """Likelihood-ratio statistic of a feature's presence (columns ``toxic`` and ``other``) against
    the label."""
    share = (F.col("toxic") + F.col("other")) / F.lit(float(n_toxic + n_other))

    def term(k, n):
        n = F.lit(float(n))
        return (F.when(k > 0, k * F.log(k / n / share)).otherwise(0.0)
                + F.when(k < n, (n - k) * F.log((1 - k / n) / (1 - share))).otherwise(0.0))
    return F.when((share > 0) & (share < 1), 2 * (term(F.col("toxic"), n_toxic) + term(F.col("other"), n_other))).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = TRAINING_ROWS) -> SeverityModel:
    """Fits the model on the labelled documents with the ``max_rows`` smallest id hashes."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
              .join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    kind = docs.schema[id_col].dataType.simpleString()
    # at most max_rows rows by construction
    sample = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
                         .groupBy("id", "label").agg(F.min("text").alias("text")), "toxicity-sample")

    def frequencies(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                for f in {f for word in _counts(text) for f in _features(word)}:
                    seen.setdefault(f, [0, 0])[label > 0] += 1
        yield {"feature": list(seen), "toxic": [x[1] for x in seen.values()], "other": [x[0] for x in seen.values()]}

    n_toxic, n_other = (x or 0 for x in sample.agg(F.sum(F.expr("int(label > 0)")), F.sum(F.expr("int(label <= 0)"))).first())
    if not n_toxic or not n_other:
        return SeverityModel({}, [])
    found = (map_rows(sample, frequencies, "feature string, toxic bigint, other bigint")
             .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
             .where(F.col("toxic") + F.col("other") >= MIN_DOCUMENTS)
             .where(F.col("toxic") * n_other != F.col("other") * n_toxic)
             # few features lean clearly to one side; only those are scored
             .where((F.col("toxic") * n_other >= 2 * F.col("other") * n_toxic)
                    | (F.col("other") * n_toxic >= 2 * F.col("toxic") * n_other))
             .withColumn("g", _statistic(n_toxic, n_other)).where(F.col("g") >= MIN_STATISTIC)
             .orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect())
    names = [r["feature"] for r in found]
    markers = frozenset(r["feature"] for r in found if r["toxic"] * n_other > r["other"] * n_toxic)
    place = {f: i for i, f in enumerate(names)}
    bare = SeverityModel(dict.fromkeys(names, 1.0), [], markers)

    def vectors(batches):
        for b in batches:
            of = [bare.vector(t) for t in b["text"]]
            yield {"id": b["id"], "label": b["label"], "at": [[place[f] for f in x] for x, _ in of],
                   "value": [list(x.values()) for x, _ in of], "density": [d for _, d in of]}

    rows = sorted(map_rows(sample, vectors, f"id {kind}, label int, at array<int>, value array<double>, density double").collect(),
                  key=lambda r: r["id"])
    grades = [1 + sum(r["density"] >= e for e in GRADE_EDGES) if r["label"] > 0 else 0 for r in rows]
    w, theta = fit_ordinal([dict(zip(r["at"], r["value"])) for r in rows], grades, len(names), len(GRADE_EDGES) + 2)
    return SeverityModel(dict(zip(names, w.tolist())), theta.tolist(), markers)


def score_documents(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade, toxic) per document row: the expected severity to 6 decimals, and its
    rounded value as grade."""
    def run(batches):
        for b in batches:
            yield {"id": b["id"], "severity": [round(model.severity(t), 6) for t in b["text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, severity double")
    return found.select("id", "severity", F.round("severity").cast("int").alias("grade"),
                        (F.col("severity") >= TOXIC).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the toxicity mark, their columns unchanged."""
    model = train(docs, labels)

    def clean(b: pa.RecordBatch, place: int) -> pa.RecordBatch:
        return b.filter(pa.array([round(model.severity(t), 6) < TOXIC for t in b.column(place).to_pylist()], pa.bool_()))

    return map_slices(docs, "text", clean)
