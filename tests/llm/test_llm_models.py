"""Whitening, SetSketch near duplicates and collocations against brute force, and the cases that
their docstrings define."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import collocations, queries, setsketch, whitening

from test_llm_text import ODD, table, words

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, x int, component int, n int"


def _vectors(spark, rows, tmp):
    path = f"{tmp}/embeddings.parquet"
    spark.createDataFrame([(i, v, 1, "a", 2, 3, 4) for i, v in rows], VECTORS).repartition(3).write.parquet(path)
    return queries.op11(spark, tmp)


def _rows(count, d, seed=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.1 * j, 1.0 / (1 + j)) + (0.5 * rng.random() if j % 2 else 0) for j in range(d)]) for i in range(count)]


ODD_VECTORS = [(None, [0.5] * 6), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] + [0.0] * 5),
               (903, [math.inf] + [0.0] * 5), (904, []), (905, [1.0, 2.0]), (906, [-0.0] * 6), (907, [0.25] * 6), (907, [0.25] * 6),
               (908, [0.25] * 6)]


@pytest.mark.parametrize("d", [1, 2, 6])
def test_whitening_matches_exact_sums_and_eigh(spark, tmpdir_path, d):
    rows = _rows(200, d) + ([r for r in ODD_VECTORS] if d == 6 else [])
    found = _vectors(spark, rows, tmpdir_path).collect()
    used = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
            if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in used})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(4, d)
    assert len(found) == k * len(used)
    by_deviation = {}
    for i, x in used:
        by_deviation.setdefault((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))), []).append(x)
    signs = {}
    for r in found:
        c = r["component"] - 1
        x = by_deviation[r["vec_id"], r["deviation"]][0]
        want = sum((a - s / n) * b for a, s, b in zip(x, sums, v[:, c])) / math.sqrt(e[c])
        assert r["n"] == n and abs(r["explained"] - e[c] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
        if abs(want) > 1e-6:
            signs.setdefault(c, set()).add(math.copysign(1, want * r["whitened"]))
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_whitening_without_variance_has_no_rows(spark, tmpdir_path, rows):
    out = _vectors(spark, rows, tmpdir_path)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not out.collect()


def test_whitening_drops_constant_dimensions_and_far_values(spark, tmpdir_path):
    flat = [(i, [float(i % 7), 3.0, 3.0]) for i in range(40)]
    out = _vectors(spark, flat, tmpdir_path).collect()
    assert {r["component"] for r in out} == {1} and out[0]["n"] == 7 and abs(out[0]["explained"] - 1) < 1e-12
    far = [(i, [i * 1e9, (i % 3) * 1e8]) for i in range(9)]
    out = _vectors(spark, far, tmpdir_path + "/far").collect()
    assert len(out) == 18 and {r["identity_error"] < 1e-9 for r in out} == {True} and any(r["deviation"] is None for r in out)


@pytest.mark.parametrize("d", [2, 5, 40])
def test_components_of_hard_matrices(d):
    """Tied, tiny and zero eigenvalues, and a shift that meets one."""
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for values in (10.0 ** -(np.arange(d) % 14), np.repeat([2.0, 1.0], [d - d // 2, d // 2]), np.ones(d), np.maximum(np.arange(d) - d // 2, 0.0),
                   np.where(np.arange(d) == 0, 1.0, np.where(np.arange(d) == 1, -1.0, 0.0))):
        for a in (q @ np.diag(values) @ q.T, np.diag(values)):
            a = (a + a.T) / 2
            for wanted in (1, min(4, d), d):
                found = whitening.leading_components(a, wanted)
                v = np.array([x for _, x in found])
                assert np.allclose([e for e, _ in found], np.sort(values)[::-1][:wanted], rtol=0, atol=1e-13)
                assert np.allclose(v @ v.T, np.eye(wanted), rtol=0, atol=1e-13)
                assert max(np.linalg.norm(a @ x - e * x) for e, x in found) < 1e-13


# ------------------------------------------------------------------ SetSketch

def _shingles(text, k=5):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def _linked(rows, percent=85):
    """Smallest reachable id of each row, by comparing all pairs."""
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if s else doc, doc == (least.get(find(i)) if s else doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def _family_rows():
    rng = random.Random(9)
    rows = list(ODD) + [(60, "a b c d"), (61, "A b  C d"), (62, "a b c d e"), (63, "a b c d e f"), (60, "another text under one id")]
    for i in range(12):  # edits at random places: similarities on both sides of the threshold
        base = words(rng, rng.choice((12, 60, 300))).split()
        for j in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 40)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(9)}"
            rows.append((100 + 10 * i + j, " ".join(own)))
    chain = words(rng, 400).split()  # each text is near the next one only
    for i in range(40):
        rows.append((1000 + (7 * i) % 40, " ".join(chain)))
        for _ in range(4):
            chain[(11 * i + 97 * _) % 400] = f"step{i}"
    passage = words(rng, 150)
    rows += [(2000 + i, words(rng, 60) + " " + passage) for i in range(30)]  # a common passage, some 0.6 alike
    rows += [(3000 + i, passage + f" {words(rng, 3)}") for i in range(40)]  # many near copies
    rows += [(None, passage + " end"), (None, words(rng, 30)), (4000, passage), (4000, passage)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket", [512, 4])
def test_setsketch_components_match_brute_force(spark, monkeypatch, bucket):
    """Also with nearly every bucket cut by a second band and by tiles."""
    monkeypatch.setattr(setsketch, "BUCKET", bucket)
    monkeypatch.setattr(setsketch, "LOT", 3 if bucket == 4 else 256)
    rows = _family_rows()
    got = setsketch.near_duplicates(table(spark, rows).repartition(5)).collect()
    want = _linked(rows)
    assert sorted(map(str, want)) == sorted(str((r["id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got)


def test_setsketch_of_small_tables(spark):
    docs = table(spark, [(1, "x"), (None, None), (2, "")])
    assert setsketch.near_duplicates(docs.limit(0)).collect() == []
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in setsketch.near_duplicates(docs).collect()}
    assert got == {1: (1, 1, True), None: (0, None, True), 2: (0, 2, True)}


def test_setsketch_tiles_hold_every_pair_of_components(spark, monkeypatch):
    """All pairs of different components of a large bucket meet in some tile."""
    monkeypatch.setattr(setsketch, "BUCKET", 5)
    one = setsketch.registers(np.arange(50, dtype=np.uint64)).astype("<u2").tobytes()
    rows = [(1, 0, 1, c, 0 if c < 20 else c, 50, bytearray(one), True, True, 33) for c in range(33)]
    members = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in setsketch._MEMBER.items()) + ", size bigint")
    groups = {}
    for r in setsketch._tiles(members).collect():
        groups.setdefault(r["key"], []).append(r)
    met = {(min(x["class"], y["class"]), max(x["class"], y["class"])) for g in groups.values() for x in g for y in g
           if x["own"] and y["other"] and x["root"] != y["root"]}
    assert met == {(a, b) for a, b in combinations(range(33), 2) if b >= 20} and max(map(len, groups.values())) < 25
    left = setsketch._unsettled(setsketch._tiles(members), 85)
    assert {r["class"] for r in left.collect()} == set(range(33))


def test_setsketch_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    for n in (1, 40, 3000):
        for j in (0.3, 0.85, 0.95):
            errors = []
            for _ in range(40):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                common, own = x[:int(j * n)], x[int(j * n):]
                a, b = np.r_[common, own[::2]], np.r_[common, own[1::2]]
                if not len(a) or not len(b):
                    continue
                ra, rb = setsketch.registers(a), setsketch.registers(b)
                assert (setsketch.registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()
                true = len(common) / len(x)
                more, equal = int((ra > rb).sum()), int((ra == rb).sum())
                u = np.array([len(a) / (len(a) + len(b))])
                errors.append(setsketch.estimate(np.array([more]), np.array([128 - more - equal]), np.array([equal]), u)[0] - true)
                if true >= 0.85:  # a link is never dismissed
                    assert setsketch.plausible(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]), 85)[0]
            assert not errors or abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


# ------------------------------------------------------------------ collocations

def _pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def _collocations(rows, max_words, min_count, keep, cover):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in _pieces(text):
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i:i + k])) for k in range(1, max_words + 1) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = []
    for lang in n:
        best = []
        for (own, p), a in found.items():
            if own != lang or any(o == lang and len(q) > len(p) and 100 * b >= cover * a and
                                  any(q[i:i + len(p)] == p for i in range(len(q))) for (o, q), b in found.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:keep], 1)]
    return sorted(out)


def _prose():
    rng = random.Random(31)
    common = "The quick, brown fox jumps over the lazy dog of Our house"
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(("new york", "San  Francisco\tbay", "a", "b", "ß", "İ", "x-y", common)) + rng.choice(("", "", "", ".", ",\n", "!?", "\x0b\x0c", "\x1c"))
                        for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(("en", "en", "de", "", None)), "s"))
    return rows + [(900, common * 3, "en", "s")] * 12 + [(901, "so " * 3000, "fr", "s"), (902, None, "en", "s"), (903, "", "fr", "s"),
                                                          (None, ". , !", None, "s"), (904, "ab" * 40_000, "fr", "s")]


@pytest.mark.parametrize("max_words, min_count, keep, cover", [(3, 10, 2000, 50), (3, 3, 7, 90), (2, 2, 5, 50), (4, 5, 50, 30)])
def test_collocations_match_brute_force(spark, monkeypatch, max_words, min_count, keep, cover):
    monkeypatch.setattr(collocations, "MAX_BITS", 15)
    rows = _prose()
    got = collocations.collocations(table(spark, rows).repartition(4), max_words=max_words, min_count=min_count, keep=keep, cover=cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = _collocations([(r[2], r[1]) for r in rows], max_words, min_count, keep, cover)
    assert sorted(tuple(r) for r in got.collect()) == want and want


def test_collocations_of_nothing(spark):
    docs = table(spark, _prose())
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(table(spark, [(1, None, None, "s"), (2, " . ", "en", "s")])).collect() == []


@pytest.mark.parametrize("overlap", [1, 2, 3])
def test_parse_counts_every_phrase_once(overlap):
    """Random texts over few words, so that triggers come close together or not at all."""
    rng = random.Random(overlap)
    for size in (0, 1, 2, 5, 40, 700, 5000):
        for vocabulary in (1, 2, 60):
            text = " ".join(rng.choice((f"w{rng.randrange(vocabulary)}",) * 9 + (".",)) for _ in range(size))
            want, got = Counter(), Counter()
            for ws in _pieces(text):
                want.update(tuple(ws[i:i + k]) for k in range(1, overlap + 2) for i in range(len(ws) - k + 1))
            for chunk in collocations.chunks(text, overlap):
                ws = chunk.decode().split(" ")
                for i in range(len(ws) - overlap):
                    got.update(tuple(ws[i:i + k]) for k in range(1, overlap + 2) if "." not in ws[i:i + k])
            assert got == want
