"""Ranked search, the n-gram join and whitening against brute force, with hot groups and awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docspark.llm import ngram_join, ranked_search, whitening

from .conftest import ITEMS, rows, vectors

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    """Scores of each item row: {position: [(score, doc_id), ...]}, best first."""
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for _, text in items:
        found = []
        for d, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((s, d))
        out.append(sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]))[:k])
    return out


def test_op11(spark, corpus):
    got = ranked_search.op11_ranked_search(spark, corpus).select("item_id", "rank", "doc_id", "score").collect()
    want = brute_search([(r[0], r[1]) for r in rows()], ITEMS)
    assert sorted(((r["item_id"], r["rank"], r["score"]) for r in got), key=str) == sorted(((item, k + 1, s) for (item, _), own in zip(ITEMS, want, strict=True) for k, (s, _) in enumerate(own)), key=str)
    assert sorted(((r["item_id"], r["score"], r["doc_id"]) for r in got), key=str) == sorted(((item, s, d) for (item, _), own in zip(ITEMS, want, strict=True) for s, d in own), key=str)


@pytest.mark.parametrize("shard", [1, 3000])
def test_op11_many_shards_blocks_and_ties(spark, monkeypatch, shard):
    """Small shards and query blocks give the results of one of each; many equal scores; common and rare terms."""
    rng = random.Random(5)
    vocabulary = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 30])))) for k in range(300)] + [(1000 + k, "same text t1 t9") for k in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=12)) + " same") for k in range(25)]
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 200)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    index = ranked_search.build_index(table)
    got = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_search(docs, items)
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == [(k, i + 1, d, s) for k, own in enumerate(want) for i, (s, d) in enumerate(own)]


def test_numbers_pack_and_unpack():
    rng = random.Random(1)
    x = np.array([0, 1, 127, 128, 2**40, *(rng.getrandbits(rng.randint(1, 60)) for _ in range(500))])
    starts = np.array([0, 3, 4, 100])
    assert [ranked_search.unpacked(p).tolist() for p in ranked_search.packed(x, starts).to_pylist()] == [p.tolist() for p in np.split(x, starts[1:])]


def test_op13(spark, corpus):
    got = whitening.op13_embedding_whitening(spark, corpus).collect()
    f32 = lambda v: float(np.float32(v))
    good = [(i, [math.floor(64 * f32(c)) + 1000000 for c in v]) for i, v, _ in vectors() if v and len(v) == 20 and all(c is not None and math.isfinite(c) and abs(c) < 1e20 for c in v)]
    x = np.array(sorted({tuple(v) for _, v in good}))
    n, sums = len(x), [sum(c) for c in zip(*x.tolist(), strict=True)]
    assert n == 60
    centred = x - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = Counter()
    for i, v in good:
        w = (np.array(v) - np.array(sums) / n) @ axes[:, :16] / np.sqrt(values[:16])
        for c in range(16):
            want[i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), round(abs(w[c]), 6), round(values[c] / values.sum(), 9)] += 1
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 9)) for r in got) == want
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_few_flat_and_large_vectors(spark):
    """Fewer vectors than dimensions, dimensions without variance, values at a great distance from zero, one hot vector."""
    rows = [(k, [2.0**40 + k * k, 5.0, float(-k), 0.0], k) for k in range(3)] + [(9, [2.0**40, 5.0, 0.0, 0.0], 9)] * 500
    got = whitening.whiten(spark.createDataFrame(rows, "id long, v array<double>, n long").repartition(7), "id", "v").collect()
    assert len(got) == 2 * 503 and {r["component"] for r in got} == {1, 2} and {r["n"] for r in got} == {3}
    assert got[0]["identity_error"] < 1e-6 and abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-9
    assert whitening.whiten(spark.createDataFrame(rows[3:], "id long, v array<double>, n long"), "id", "v").collect() == []


def test_triangle_merges_as_a_tree(spark, monkeypatch):
    """Many tasks and levels give the triangle of the whole matrix, up to signs."""
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1000, (200, 5))
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(11)
    sums = x.sum(axis=0).tolist()
    r = whitening.triangle(df, len(x), sums)
    c = x - np.array(sums) / len(x)
    assert np.allclose(r.T @ r, c.T @ c) and np.allclose(r, np.triu(r))


def brute_join(pairs, width=4, low=85):
    """(doc_id, set size, component's least doc_id) of each row, by comparing all sets; None sorts last."""
    sets = []
    for _, text in pairs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, min(len(w), 1)))))
    low_of = list(range(len(pairs)))

    def root(k):
        while low_of[k] != k:
            k = low_of[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= low * len(sets[a] | sets[b]):
                low_of[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(pairs):
        least[root(k)] = min(least.get(root(k), (True, 0)), (d is None, d or 0))
    return [(d, len(s), None if least[root(k)][0] else least[root(k)][1]) for k, ((d, _), s) in enumerate(zip(pairs, sets, strict=True))]


def joined(spark, pairs):
    found = ngram_join.join_components(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3))
    return sorted((tuple(r) for r in found.select("id", "n_shingles", "component_id").collect()), key=str)


def test_op12(spark, corpus):
    got = ngram_join.op12_ngram_join(spark, corpus).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_join([(r[0], r[1]) for r in rows()]), key=str)


def edited(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_op12_families_near_the_threshold_and_common_passages(spark):
    """Copies with more and fewer edits than the threshold allows, a passage in every third text, short texts that differ by a word, chains."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    pairs, at = [], 0
    for size in (8, 9, 12, 30, 90, 200):
        base = [word() for _ in range(size)]
        for edits in (0, 1, 1, 2, 3, 5, 8):
            for _ in range(4):
                pairs.append((at := at + 1, edited(rng, base, min(edits, size // 8 + 1)) + rng.choice(["", " tail", " two more"])))
    for _ in range(60):
        own = [word() for _ in range(rng.choice([20, 60, 150]))]
        pairs.append((at := at + 1, " ".join(own[:10] + passage + own[10:])))
    chain = [word() for _ in range(140)]
    for k in range(12):
        pairs.append((at := at + 1, " ".join(chain[k * 4 : k * 4 + 80])))
    pairs += [(at + 1, "a b c"), (at + 2, "A b c"), (at + 3, "a b c d"), (at + 4, "a b c d a b c d"), (7, edited(rng, passage, 0)), (None, edited(rng, passage, 0)), (None, "x"), (at + 4, None)]
    rng.shuffle(pairs)
    want = brute_join(pairs)
    assert len({c for _, _, c in want}) < len(want) - 30
    assert joined(spark, pairs) == sorted(want, key=str)


def test_op12_members_of_one_group_are_compared(spark):
    """Sets of one size and one prefix that are no near copies of each other: their early shingles are the common ones, the rest differs in pairs."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(100)]
    tails = [[f"t{j}x{k}" for k in range(14)] for j in range(4)]
    pairs = [(10 * j + i, " ".join(base + tails[j] + [f"end{i % 2}"])) for j in range(4) for i in range(6)]
    rng.shuffle(pairs)
    assert joined(spark, pairs) == sorted(brute_join(pairs), key=str)


def test_op12_a_family_costs_about_a_comparison_a_member(spark, monkeypatch):
    """Pairs that are confirmed on full sets grow with the members of a family of near copies, not with their square."""
    counted = []
    real = ngram_join.confirmed

    def confirmed(pairs, sets, threshold):
        counted.append(pairs.count())
        return real(pairs, sets, threshold)

    monkeypatch.setattr(ngram_join, "confirmed", confirmed)
    monkeypatch.setattr("docspark.llm.near_dedup.confirmed", confirmed)
    rng = random.Random(10)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    sums = []
    for m in (60, 240):
        counted.clear()
        pairs = [(k, edited(rng, base, 1)) for k in range(m)]
        assert {c for _, _, c in joined(spark, pairs)} == {0}
        sums.append(sum(counted))
    assert sums[1] < 8 * 240


def test_op12_heads_hold_what_a_link_needs():
    """The bound of the first look, for all sizes and least overlaps."""
    n = np.arange(1, 1200)
    head, need = ngram_join.head_length(n), ngram_join.head_need(n)
    for x in n.tolist():
        y = np.arange(-(-85 * x // 100), x + 1)
        o = -(-85 * (x + y) // 185)
        y, o = y[o <= y], o[o <= y]
        both = np.minimum(np.minimum(head[x - 1] - x + o, head[y - 1] - y + o), o)
        assert (both >= need[x - 1]).all() and (both >= need[y - 1]).all()
