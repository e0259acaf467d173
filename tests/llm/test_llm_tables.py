"""Mixing, packing, token files, top-k search, fixity audits and the pipeline."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, token_files, topk, warc
from tessera.llm.common import materialise

from test_llm_text import ODD, table, words

# ------------------------------------------------------------------ mixing

LEVELS = {"domain": "substr(source, 1, 1)", "language": "lang", "origin": "source"}


def _fill(children, budget):
    """Water filling by fractions: {name: (weight, capacity)} to shares."""
    share, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if c * total <= w * budget}
        if not full:
            return share | {n: budget * w / total for n, (w, _) in open_.items()}
        for n in full:
            share[n] = open_.pop(n)[1]
            budget -= share[n]
    return share


def _tree_shares(supply, weights, budget, epochs, depth=0):
    groups = {}
    for path, s in supply.items():
        groups.setdefault(path[: depth + 1], {})[path] = s

    def cap(path, own):
        if weights.get(path, 1) == 0:
            return 0
        if len(path) == 3:
            return own[path] * epochs
        return sum(cap(p, {q: s for q, s in own.items() if q[: len(p)] == p}) for p in {q[: len(path) + 1] for q in own})
    children = {p: (weights.get(p, 1), cap(p, own)) for p, own in groups.items()}
    share = _fill({p: x for p, x in children.items() if x[1]}, budget)
    if depth == 2:
        return {p: share.get(p, 0) for p in groups}
    return {q: b for p, own in groups.items() for q, b in
            (_tree_shares(own, weights, share[p], epochs, depth + 1) if p in share else dict.fromkeys(own, 0)).items()}


def _mix_rows():
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randrange(60)), rng.choice(("en", "en", "en", "de", "", None)), rng.choice(("a1", "a2", "b1", "c1", "c2", None)))
            for i in range(400)]
    return rows + [(500, words(rng, 9), "en", "a1")] * 3 + [(None, words(rng, 5), "en", "a1"), (None, None, "en", "a1")] + ODD


WEIGHTS = {("a",): 5, ("b",): 3, ("a", "en"): 4, ("c", "en", "c2"): 0, ("b", "en"): 1, ("b", "de"): 9}


@pytest.mark.parametrize("budget", [(1, 2), (5, 3), (9, 1), (0, 1)])
def test_budgets_and_prefixes(spark, budget):
    units, plan = mixing.mix_plan(table(spark, _mix_rows()), LEVELS, WEIGHTS, budget, 2, 7)
    plan = {(r["domain"], r["language"], r["origin"]): r for r in plan.collect()}
    supply = {p: r["supply"] for p, r in plan.items()}
    want = _tree_shares({p: s for p, s in supply.items() if s}, WEIGHTS, sum(supply.values()) * budget[0] // budget[1], 2)
    for p, r in plan.items():
        assert abs(r["budget"] - want.get(p, 0)) < 3 and r["budget"] <= 2 * r["supply"], p
    capacity = sum(2 * s for p, s in supply.items() if p != ("c", "en", "c2"))
    assert sum(r["budget"] for r in plan.values()) == min(capacity, sum(supply.values()) * budget[0] // budget[1])
    taken = Counter()
    for r in mixing.mixed_units(units, materialise(spark.createDataFrame(list(plan.values()), mixing.mix_plan(
            table(spark, _mix_rows()), LEVELS, WEIGHTS, budget, 2, 7)[1].schema), "p"), list(LEVELS), 7).collect():
        taken[r["domain"], r["language"], r["origin"]] += r["take"]
        assert 0 <= r["take"] <= r["tokens"]
    assert all(taken[p] == r["budget"] for p, r in plan.items())  # to the token


def test_mix_is_seeded_and_keeps_columns(spark):
    docs = table(spark, _mix_rows())

    def ids(seed):
        _, plan = mixing.mix_plan(docs, LEVELS, WEIGHTS, (1, 2), 2, seed)
        out = mixing.mix_documents(docs, plan, LEVELS, seed)
        assert out.columns == docs.columns
        return sorted(str(r["doc_id"]) for r in out.collect())
    assert ids(1) == ids(1) != ids(2)
    units, plan = mixing.mix_plan(docs.limit(0), LEVELS, {}, (1, 2), 2, 1)
    assert mixing.mixed_units(units, plan, list(LEVELS), 1).count() == 0


def test_rows_without_id_fill_the_budget_one_by_one(spark):
    rng = random.Random(8)
    rows = [(None if i % 3 else i, words(rng, 10 + i % 7), "en", "a1") for i in range(300)] + [(5, words(rng, 9), "en", "a1")] * 2
    docs = table(spark, rows)
    total = sum(len(t.split()) for _, t, _, _ in rows)
    for seed in range(3):
        _, plan = mixing.mix_plan(docs, LEVELS, {}, (1, 2), 1, seed, by_row=True)
        out = mixing.mix_documents(docs, plan, LEVELS, seed, by_row=True).collect()
        assert 0 <= sum(len(r["text"].split()) for r in out) - total // 2 < 18
        assert 60 < sum(r["doc_id"] is None for r in out) < 140


# ------------------------------------------------------------------ packing

def _plain_best_fit(lengths, allowed, cost):
    room, fill, where = [], [], []

    def price(c, n, rest):
        held = n
        for m in rest:
            held += m if held + m <= c else 0
        return min(cost[x] for x in allowed if x >= held) / held
    for at, n in enumerate(lengths):
        fitting = [i for i in range(len(room)) if room[i] >= n]
        if not fitting:
            size = min((c for c in allowed if c >= n), key=lambda c: (price(c, n, lengths[at + 1:]), c))
            room.append(size)
            fill.append(0)
            fitting = [len(room) - 1]
        best = min(room[i] for i in fitting)
        i = next(i for i in fitting if room[i] == best)
        room[i] -= n
        fill[i] += n
        where.append(i)
    return where, fill


def test_best_fit_matches_the_plain_rule_and_subsets_compete():
    rng = random.Random(3)
    sizes, cost = [16, 32, 64], {16: 20, 32: 34, 64: 66}
    for _ in range(50):
        lengths = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(1, 80))), reverse=True)
        bins, offsets, fill = packing.best_fit(lengths, sizes, cost)
        _, plain = _plain_best_fit(lengths, sizes, cost)
        assert Counter(fill) == Counter(plain)
        bins, offsets, fill, downsized = packing.pack_shard(lengths, sizes, cost)
        assert all(f <= d and d == min(s for s in sizes if s >= f) for f, d in zip(fill, downsized))
        at = Counter()
        for n, b, o in zip(lengths, bins, offsets):
            assert o == at[b]
            at[b] += n
        for allowed in ([16], [32], [64], [16, 32], [16, 64], [32, 64], sizes):
            if allowed[-1] >= lengths[0]:
                _, other = _plain_best_fit(lengths, allowed, cost)
                assert sum(cost[d] for d in downsized) <= sum(cost[min(s for s in sizes if s >= f)] for f in other)


def _least_cost(lengths, sizes, cost):
    """The optimum over all partitions of the pieces into bins."""
    whole = (1 << len(lengths)) - 1
    tokens = [sum(n for i, n in enumerate(lengths) if mask >> i & 1) for mask in range(whole + 1)]
    own = [min((cost[c] for c in sizes if c >= t), default=math.inf) for t in tokens]
    best = [0] + [math.inf] * whole
    for mask in range(1, whole + 1):
        first, sub = mask & -mask, mask
        while sub:
            if sub & first:
                best[mask] = min(best[mask], own[sub] + best[mask ^ sub])
            sub = (sub - 1) & mask
    return best[whole]


@pytest.mark.parametrize("sizes", [[16, 32, 64], [15, 41], [10, 27, 33, 64]])
def test_packing_is_near_the_exhaustive_optimum(sizes):
    rng, cost, paid, least = random.Random(9), {c: c + 2 for c in sizes}, 0, 0
    for _ in range(60):
        lengths = sorted((rng.randrange(1, sizes[-1] + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        got, want = sum(cost[s] for s in packing.pack_shard(lengths, sizes, cost)[3]), _least_cost(lengths, sizes, cost)
        assert want <= got <= 1.5 * want
        paid, least = paid + got, least + want
    assert paid <= 1.06 * least


def test_a_long_piece_does_not_make_the_short_ones_dear():
    cost = {1500: 1532, 4096: 4128}
    *_, downsized = packing.pack_shard([3000] + [1400] * 4000, [1500, 4096], cost)
    assert sum(cost[s] for s in downsized) == 4128 + 4000 * 1532


def test_packing_places_every_token_once(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(300))) for i in range(300)] + ODD + [(7, "a b c")] * 5
    got = packing.pack(table(spark, rows), [32, 64, 128], shard_pieces=100).collect()
    want = Counter((i, len([w for w in (t or "").encode().split()])) for i, t in rows)
    pieces = {}
    for r in got:
        pieces.setdefault((r["id"], r["copy"], r["bin"] is None), []).append(r)
    sums = Counter()
    for (i, _, none), rs in pieces.items():
        if none:
            sums.update({(i, 0): 1})
    whole = {}
    for r in got:
        if r["bin"] is not None:
            assert r["start"] == 128 * r["piece"] and r["bin_tokens"] <= r["bin_length"] in (32, 64, 128)
            whole.setdefault(r["bin"], []).append(r)
    for rs in whole.values():
        rs.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in rs:
            assert r["bin_offset"] == at
            at += r["length"]
        assert at == rs[0]["bin_tokens"]
    total = sum(r["length"] for r in got)
    assert total == sum(n * c for (_, n), c in want.items())
    assert sums == Counter({k: c for k, c in want.items() if k[1] == 0})
    assert packing.pack(table(spark, []), [32]).count() == 0


# ------------------------------------------------------------------ token files

def _kraft_optimum(counts, limit):
    """Least total cost over all length multisets, by dynamic programming over (leaf, free nodes)."""
    counts = sorted(counts, reverse=True)
    n, best = len(counts), {0: {1: 0}}
    state = {(0, 1): 0}
    for level in range(limit + 1):
        after = {}
        for (done, free), c in state.items():
            for here in range(min(free, n - done) + 1):
                if level == 0 and here and n > 1:
                    continue
                rest = sum(counts[done + here:])
                key = (done + here, min(2 * (free - here), 2 * n))
                cost = c + rest
                if after.get(key, math.inf) > cost:
                    after[key] = cost
        state = after
    return min(c for (done, _), c in state.items() if done == n)


def test_code_lengths_are_optimal_under_the_limit():
    rng = random.Random(5)
    for _ in range(30):
        n, limit = rng.randrange(2, 9), rng.randrange(3, 6)
        counts = np.array([rng.choice((1, 2, 3, 10, 100, 1000)) for _ in range(n)])
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -lengths) <= 1
        assert int((lengths * counts).sum()) == _kraft_optimum(counts.tolist(), limit)
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9), 3)


def test_blocks_decode_from_every_checkpoint():
    rng = np.random.default_rng(1)
    for n, spread in ((1, 1), (255, 3), (256, 500), (5000, 40_000), (3, 1)):
        ids = (rng.random(n) ** 4 * spread).astype(np.int64)
        own, counts = np.unique(ids, return_counts=True)
        book = token_files.Codebook(own, token_files.code_lengths(counts, 16))
        payload, checkpoints = token_files.encode_block(ids, *book.for_encoding())
        assert (token_files.decode_block(payload, checkpoints, n, book.for_decoding()) == ids).all()
        k = len(checkpoints) // 2  # from a checkpoint in the middle
        assert (token_files.decode_block(payload, checkpoints[k:], n - 256 * k, book.for_decoding()) == ids[256 * k:]).all()


def test_token_files_round_trip(spark, tmpdir_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    config = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tokenizer, rng = Tokenizer.from_str(config), random.Random(6)
    rows = ODD + [(i, words(rng, rng.randrange(200))) for i in range(50)] + [
        (90, "Don't STOP's it'll <|endoftext|>a<|startoftext|> é́x naïve, Ünïcode! ΑΣ ΣΑΣ. İstanbul ǅ 漢字かな 12,5% x y z a...b ſ K"),
        (91, "Hello, world!?! foo|bar #tag* & % $5 it's ''s ªº µm ß"), (92, "word " * 3000)]
    docs = table(spark, rows)
    encoded = materialise(token_files.encode_words(docs, config, 1), "t")
    token_files.write_token_files(encoded, tmpdir_path + "/files", block=500)
    got = token_files.read_token_files(spark, tmpdir_path + "/files").collect()
    want = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    assert sorted(str((r["id"], r["ids"])) for r in got) == sorted(map(str, want))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    ids = [r["id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    sums = {r["start"]: r["crc"] for r in token_files.read_checksums(spark, tmpdir_path + "/files").collect()}
    assert all(sums[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    token_files.write_token_files(materialise(token_files.encode_words(docs.limit(0), config, 1), "t"), tmpdir_path + "/none")
    assert token_files.read_token_files(spark, tmpdir_path + "/none").count() == 0


# ------------------------------------------------------------------ top k

@pytest.mark.parametrize("block", [2048, 3])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=20) * rng.choice((0.1, 1, 30))).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(500, rows[3][1])] * 2  # ties and repeated rows
    rows += [(50, rows[50][1])] * 7 + [(100, rows[101][1]), (100, [9.0] * 20), (None, rows[3][1]), (None, rows[150][1])]
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan")] * 20), (603, [float("inf")] * 20), (None, [1.0] * 20), (650, [1.0, 2.0]),
             (651, [3.0, -1.0]), (700, []), (701, []), (750, [0.0] * 20), (800, [1e7] * 20)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(5)
    got = topk.exact_top_k(df.where("id % 50 = 0"), df.withColumn("score", F.lit(1)), 5).collect()
    good = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % 50 == 0:
            near = sorted((-int(v @ w), j is None, j or 0) for b, (j, w) in enumerate(good) if a != b and len(w) == len(v))[:5]
            want += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(near)]
    assert sorted(map(str, ((r["query_id"], r["rank"], r["id"], r["score"]) for r in got))) == sorted(map(str, want))
    assert topk.exact_top_k(df.limit(0), df, 5).count() == 0 == topk.exact_top_k(df.where("id = 0"), df.limit(0), 5).count()


def test_bounds_prune():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(2000, 16)).cumsum(axis=1))
    s = topk.Searcher(np.arange(4), np.array([-1, -2, -3, -4]), x[:4], 3)
    exact, seen = s._exact, []
    s._exact = lambda q, c, v: seen.append(len(q)) or exact(q, c, v)
    for at in range(0, 2000, 100):
        s.add(np.arange(at, at + 100), x[at:at + 100])
    assert sum(seen) < 0.5 * 4 * 2000


# ------------------------------------------------------------------ fixity

def test_audit_locates_every_difference(spark):
    rng = random.Random(8)
    rows = [(f, o, 100, f"d{f}-{o}") for f in range(6) for o in range(0, 100 * 300, 100)]
    other = list(rows)
    for r in rng.sample(rows, 7):
        other[other.index(r)] = (*r[:3], "bad")
    gone = rng.choice(other)
    other.remove(gone)
    other += [(2, 10**6, 5, "new"), (9, 0, 5, "new file"), (1, 0, 100, "d1-0")]  # the last repeats a record
    schema = "file bigint, offset bigint, length bigint, digest string"
    a, b = (spark.createDataFrame(x, schema).withColumn("node", F.lit(1)) for x in (rows, other))
    got = {(r["file"], r["offset"]): r["status"] for r in warc.audit(a, b, range_bytes=500, fanout=4).collect()}
    left, right = Counter(rows), Counter(other)
    want = {}
    for r in (left - right) | (right - left):
        sides = [any(x[:2] == r[:2] for x in side) for side in (left, right)]
        want[r[:2]] = "changed" if all(sides) else "missing" if sides[0] else "extra"
    assert got == want
    assert warc.audit(a, a).count() == 0 and warc.audit(a.limit(0), b.limit(0)).count() == 0
    assert {r["status"] for r in warc.audit(a, b.limit(0), 500, 4).collect()} == {"missing"}


def test_archive_index_is_contiguous(spark):
    rows = [(i % 50 if i % 3 else None, i % 7 + 1, f"{i % 11}") for i in range(500)]
    got = warc.archive_index(spark.createDataFrame(rows, "k bigint, length bigint, digest string"), "k", 40).collect()
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append((r["offset"], r["length"], r["k"]))
    assert len(got) == 500 and sorted(files) == list(range(13)) and all(len(v) == 40 for f, v in files.items() if f < 12)
    for v in files.values():
        at = 0
        for o, n, _ in sorted(v):
            assert o == at
            at += n
    order = [k for f in sorted(files) for _, _, k in sorted(files[f])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, tmpdir_path):
    import corpus_pipeline

    from test_llm_text import _toxic_rows
    rng = random.Random(10)
    rows, labels = _toxic_rows(rng, 300, 1000)
    bad = {i for i, t in labels if t}
    rows += [(i + 5000, t) for i, t in rows[:60]] + [(9000, "token=0123456789abcdef " + words(rng, 80))] + ODD
    rows = [(i, t, rng.choice(("en", "de", None)), rng.choice(("src1", "src2", "src7", None))) for i, t in rows]
    docs = table(spark, rows)
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(tmpdir_path + "/labels.parquet")
    docs.write.parquet(tmpdir_path + "/documents.parquet")
    docs, before = spark.read.parquet(tmpdir_path + "/documents.parquet"), docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, tmpdir_path), "stage")
        held = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != names[-1]:
            assert out.columns == before
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            assert held - ids == {i for i in held if i is not None and (i in bad or i - 5000 in bad)}
        if name == "near duplicates":
            assert not {i for i in ids if i is not None and 6000 <= i < 9000} and ids >= {i for i in held if i and 1000 <= i < 2000}
        if name == "secrets":
            assert ids == held and out.where("doc_id = 9000 and text like '[secret] %'").count() == 1
        docs = out
    assert corpus_pipeline.run(spark, tmpdir_path).count() == docs.count()
    os.makedirs(tmpdir_path + "/none")
    table(spark, []).write.parquet(tmpdir_path + "/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(tmpdir_path + "/none/labels.parquet")
    assert corpus_pipeline.run(spark, tmpdir_path + "/none").count() == 0
