"""Every operator on the awkward tables, against brute force, and on empty tables."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docspark.llm import fingerprint, line_dedup, mixing, near_dedup, packing, quality_rules, rule_ensemble, substring_dedup, toxicity
from docspark.llm.common import documents
from docspark.llm.registry import QUERIES

from .conftest import rows

TEXTS = [(r[0], r[1] or "") for r in rows()]


def words(text):
    return text.encode().split()


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_op1(spark, corpus):
    got = toxicity.op1_toxicity(spark, corpus).collect()
    assert len(got) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_machine_learns_a_pair_that_sums_miss():
    rng = np.random.default_rng(0)
    sets, labels = [], []
    for _ in range(3000):
        has = rng.random(2) < 0.5
        labels.append(float(has.all()))
        sets.append(np.array([k for k in (1, 2) if has[k - 1]] + [int(rng.integers(10, 60))]))
    m = toxicity.train(sets, np.array(labels))
    score = lambda s: toxicity.margins(np.searchsorted(m.buckets, s), np.array([0, len(s)]), m.constant, m.weights, m.factors)[0][0]
    assert set(m.buckets) >= {1, 2}
    assert score([1, 2]) > 1 > 0 > max(score([1]), score([2]))
    assert (m.factors[0] @ m.factors[1]) > 0


def test_machine_learns_terms_that_matter_only_jointly():
    """Labels by exclusive or: either term alone says nothing, and no sum of weights separates."""
    rng = np.random.default_rng(2)
    sets, labels = [], []
    for _ in range(3000):
        has = rng.random(2) < 0.5
        labels.append(float(has[0] != has[1]))
        sets.append(np.array([k for k in (1, 2) if has[k - 1]] + [int(rng.integers(10, 60))]))
    m = toxicity.train(sets, np.array(labels))
    assert set(m.buckets) >= {1, 2} and len(m.buckets) < 10
    score = lambda s: toxicity.margins(np.searchsorted(m.buckets, np.array(s, dtype=int)), np.array([0, len(s)]), m.constant, m.weights, m.factors)[0][0]
    assert min(score([1]), score([2])) > 1 and max(score([1, 2]), score([])) < -1


def brute_lines(pairs, run=3, long=50):
    """Lines kept of each (id, text): the longest repeats of earlier runs are deleted, if they have ``run`` lines or a line of ``long`` words."""
    first, gone = {}, collections.defaultdict(set)
    for key, text in sorted(set(pairs)):
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = [at[k : k + run] for k in range(len(at) - run + 1)] + [[k] for k in at if len(words(lines[k])) >= long]
        for own in runs:
            w = tuple(lines[i] for i in own)
            if w in first:
                gone[key, text].update(own)
            first.setdefault(w, (key, own))
    return {p: [x for k, x in enumerate((p[1] or "").split("\n")) if k not in gone[p]] for p in set(pairs)}


def test_op2_extends_matches_and_finds_long_lines(spark):
    """Each pair of texts: what two of them share, line by line as far as it agrees, goes from the later one; so does a long line alone."""
    from .conftest import prose

    lines = [prose(700 + k, 8) for k in range(12)]
    alone, two = prose(720, 60), [prose(721 + k, 8) for k in range(2)]
    texts = [
        "\n".join(["start", *lines, "end"]), "\n".join(["other", *lines[2:11], "stop"]), "\n".join([*lines[:2], "x y", *lines[5:7]]),
        "\n".join(["a b", alone, *two]), "\n".join(["c d", alone, "e f", *two]), alone, "\n".join([alone, "", alone]),
        "\n".join([lines[5], "other", lines[6], lines[7]]), "\n".join(lines[4:9] + ["  "] + lines[9:12]),
    ]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(df).collect()}
    assert got[1] == "other\nstop" and got[2] == texts[2] and got[4] == "\n".join(["c d", "e f", *two]) and got[5] == "" and got[6] == ""
    want = brute_lines(pairs)
    assert got == {k: "\n".join(want[k, t]) for k, t in pairs}


def test_op2(spark, corpus, docs):
    want = brute_lines(TEXTS)
    got = line_dedup.op2_line_dedup(spark, corpus).collect()
    assert sorted((r["doc_id"], r["kept_sha256"]) for r in got) == sorted((k, hashlib.sha256("\n".join(want[k, t]).encode()).hexdigest()) for k, t in TEXTS)
    assert sum(r["n_removed_lines"] for r in got) > 0
    kept = line_dedup.remove_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "", r["n_chars"] or 0) for r in kept.collect()) == sorted((k, "\n".join(want[k, t]), len("\n".join(want[k, t]))) for k, t in TEXTS)


def test_op3(spark, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = collections.Counter()
    for k, x in TEXTS:
        want[k, tuple([*t.encode(x, add_special_tokens=False).ids, 1])] += 1
    got = packing.op3_packing(spark, corpus).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        total = sum(r["length"] for r in own)
        assert total == 2048 or total & (total - 1) == 0 and total < 2048
    pieces = collections.Counter((r["doc_id"], r["start"], r["length"]) for r in got)
    crcs = {(r["doc_id"], r["start"], r["length"]): r["ids_crc32"] for r in got}
    for (k, ids), n in want.items():
        if n == 1:
            own = sorted(p[1:] for p in pieces if p[0] == k)
            assert sum(x[1] for x in own) == len(ids)
            assert all(crcs[k, a, m] == zlib.crc32(np.array(ids[a : a + m], dtype="<u4").tobytes()) for a, m in own)
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())


def test_balanced_fills_rooms_exactly():
    lengths = [2000, 1500, 900, 700, 3, 1]
    total = sum(lengths)
    rooms = [2048] * (total // 2048) + packing.powers(total % 2048)
    left = list(rooms)
    for _, _, n, room in packing.balanced(lengths, rooms):
        left[room] -= n
    assert left == [0] * len(rooms)


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_op4(spark, corpus, tmp_path):
    from docspark.llm import secret_scan

    def base(t):
        found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))

    got = secret_scan.op4_secret_scans(spark, corpus).collect()
    assert sorted((r["doc_id"], r["base_sha256"]) for r in got) == sorted((k, hashlib.sha256(base(t).encode()).hexdigest()) for k, t in TEXTS)
    # A second scan with one more rule looks at that rule alone; a third has nothing to do.
    versions = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "ghp_" + "a" * 36)], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    count = lambda df: df.groupBy("blob").count().count(), lambda df: df.count()
    one = secret_scan.scan_new_blobs(versions, path, secret_scan.BASE_RULES)
    assert [f(one) for f in count] == [2, 2]
    two = secret_scan.scan_new_blobs(versions, path, secret_scan.RULES)
    assert [f(two) for f in count] == [2, 4]
    three = secret_scan.scan_new_blobs(versions, path, secret_scan.RULES)
    assert three.count() == 4
    found = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["findings"]] for r in secret_scan.findings_by_path(versions, three).collect()}
    assert found == {1: [("assign", 0, 14)], 2: [("assign", 0, 14)], 3: [("hosting_token", 0, 40), ] if not re.search("[0-9a-f]{24}", "ghp_" + "a" * 36) else [("hosting_token", 0, 40), ("hex", 4, 40)]}


def test_op4_changed_rule(spark, tmp_path):
    """A rule's new version is scanned anew and the old one's findings are no longer returned; many matches in one text are placed."""
    from docspark.llm import secret_scan
    from docspark.llm.secret_scan import Rule

    many = "x token=abcdefgh é" * 5000
    versions = spark.createDataFrame([(1, "token=abcdefgh"), (2, many)], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    old, new = (Rule("assign", "token=[a-z]+"),), (Rule("assign", "token=[0-9]+", version=2),)
    show = lambda ledger, rules: {r["doc_id"]: [(x["start"], x["end"]) for x in r["findings"]] for r in secret_scan.findings_by_path(versions, ledger, rules).collect()}
    first = secret_scan.scan_new_blobs(versions, path, old)
    assert show(first, old) == {1: [(0, 14)], 2: [(m.start(), m.end()) for m in re.finditer("token=[a-z]+", many)]}
    second = secret_scan.scan_new_blobs(versions, path, new)
    assert show(second, new) == {1: [], 2: []} and show(second, old)[1] == [(0, 14)]


def test_op5(spark, corpus, docs):
    def counts(t):
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(grams)
        hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    got = quality_rules.op5_quality_rules(spark, corpus).collect()
    assert sorted((r["doc_id"], *(r[c] for c in quality_rules.COUNTS)) for r in got) == sorted((k, *counts(t)) for k, t in TEXTS)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality_posterior"] >= 0.5)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def test_em_finds_which_rules_to_trust():
    rng = np.random.default_rng(1)
    m = len(quality_rules.RULES)
    truth = rng.random(20_000) < 0.7
    right = np.linspace(0.6, 0.95, m)
    votes = [tuple(int(v) for v in np.where(rng.random(m) < 0.2, 0, np.where(rng.random(m) < right, 1, -1) * (1 if y else -1))) for y in truth]
    model = quality_rules.fit_votes(list(collections.Counter(votes).items()))
    assert abs(model.prior - 0.7) < 0.03
    assert np.abs(np.array(model.on_good) - right).max() < 0.04


def test_op6(spark, corpus):
    got = rule_ensemble.op6_quality_classifier(spark, corpus).collect()
    assert len(got) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_op7(spark, corpus, docs):
    got = mixing.op7_mixing(spark, corpus).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((k, len(words(t))) for k, t in TEXTS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = collections.defaultdict(int)
    for r in got:
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(taken - target) <= 0.01 * size + 2 for (size, target), taken in by.items())
    again = mixing.op7_mixing(spark, corpus).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = collections.Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert +taken == +want


def test_targets_and_counts():
    found = mixing.targets([("b", 1000), ("a", 10), (None, 500)])
    assert [(s.name, s.size) for s in found] == [("a", 10), ("b", 1000), (None, 500)]
    assert found[0].target == 20 and abs(sum(s.target for s in found) - 1.5 * 1510) < 1e-6
    assert abs(found[1].target / found[2].target - 2) < 1e-9 or found[1].target == 2000
    lengths = [64] * 9 + [34]
    counts = mixing.shard_counts([500, 20, 0, 90], np.random.default_rng(3), lengths)
    assert counts.sum(axis=0).tolist() == [500, 20, 0, 90] and counts.sum(axis=1).tolist() == lengths


def test_draws_of_all_sizes_follow_one_distribution():
    """Probabilities of a small draw against counted ones, moments of a pool as at 100 TB."""
    rng = np.random.default_rng(5)
    got = collections.Counter(mixing._hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    for k in range(6):
        want = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(got[k] / 20_000 - want) < 5 * math.sqrt(want * (1 - want) / 20_000) + 1e-9
    good, bad, n = 7 * 10**9, 60 * 10**9, 10**6
    share = good / (good + bad)
    many = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(400)])
    sd = math.sqrt(n * share * (1 - share))
    assert abs(many.mean() - n * share) < 5 * sd / 20 and 0.8 < many.std() / sd < 1.2
    assert mixing._hypergeometric(rng, 5, 3, 8) == 5 and mixing._hypergeometric(rng, 0, 4, 2) == 0 and mixing._hypergeometric(rng, 4, 0, 2) == 2


def test_op7_null_ids_and_equal_rows_fill_no_task(spark, monkeypatch):
    """A third of the rows without an id, a third the same row: no part of the placing holds more than a few times its share; the words are all placed once."""
    monkeypatch.setattr(mixing, "RUN", 10)
    pairs = [(None, f"null {k} " + "w " * (k % 7), "a", k) for k in range(1000)] + [(5, "the same row", "a", 0)] * 1000 + [(k, "own " * (k % 9), "b", 0) for k in range(10, 1010)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string, source string, start long").repartition(4)
    small = docs.select("doc_id", "source", F.size(F.array_remove(F.split("text", " "), "")).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
    runs = mixing.counted(small, "doc_id", "tie")
    n = runs.count()
    parts = math.isqrt(n)
    assert runs.agg(F.sum("_n")).first()[0] == 3000
    assert runs.groupBy(F.pmod("_part_key", F.lit(parts))).agg(F.sum("_n").alias("rows")).agg(F.max("rows")).first()[0] < 3000 / 5
    rows, sources = mixing.located(small, "doc_id", "tie")
    placed = collections.defaultdict(list)
    for r in rows.collect():
        placed[r["source"]].append((r["start"], r["size"]))
    for s in sources:
        own = sorted(placed[s.name])
        ends = np.cumsum([size for _, size in own])
        assert [at for at, _ in own] == [0, *ends[:-1].tolist()] and ends[-1] == s.size
    taken = collections.Counter()
    for r in mixing.taken(rows, sources, 7).collect():
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words_of = collections.Counter()
    for r in mixed.collect():
        words_of[r["source"]] += len(words(r["text"]))
    assert all(abs(x[s.name] - s.target) <= 0.01 * s.size + 2 for s in sources for x in (taken, words_of))


def test_slots_of_tiny_sources():
    """A target of twice the size is two passes of all blocks; any other target is met to a word, however small the source."""
    for size in (1, 5, 8, 32, 33, 40, 255, 257, 1000, 99_999):
        twice = mixing.Source("x", size, 2.0 * size)
        assert twice.slots()[0] == 2 * twice.blocks()
        once = mixing.Source("x", size, float(size))
        assert once.slots()[0] == once.blocks()
        some = mixing.Source("x", size, 1.4 * size)
        n, last = some.slots()
        assert abs((n - 1) * size / some.blocks() + last - some.target) <= 1.5
    assert mixing.Source("none", 0, 0.0).slots() == (0, 0)


@pytest.mark.parametrize("driver_counts", [1, 1000])
def test_slots_cover_every_pass(spark, driver_counts):
    """Each pass of a source takes each of its blocks once, for any number of groups of shards; shards have equal length."""
    sources = [mixing.Source("a", 1000, 1700.0), mixing.Source(None, 90, 180.0), mixing.Source("c", 3000, 500.0)]
    got = mixing.slots(spark, sources, 7, block=8, shard_slots=16, driver_counts=driver_counts).collect()
    per = collections.Counter(r["shard"] for r in got)
    assert {n for k, n in per.items() if k < max(per)} == {16}
    for j, s in enumerate(sources):
        times = collections.Counter(r["block"] for r in got if r["source_no"] == j)
        n = s.blocks(8)
        passes, rest = divmod(s.slots(8)[0], n)
        assert all(0 <= k < n for k in times) and collections.Counter(times[k] for k in range(n)) == +collections.Counter({passes + 1: rest, passes: n - rest})


def test_permutation_is_one():
    got = mixing.permuted(np.arange(74), np.full(74, 37), np.full(74, 5)).tolist()
    one, two = got[:37], got[37:]
    assert sorted(one) == sorted(two) == list(range(37)) and one != two


def test_op7_targets_are_met(spark, tmp_path):
    """Sizes, targets and sums on 600 documents against an independent computation: water filling by bisection."""
    rng = np.random.default_rng(1)
    names = ["hot"] * 200 + [f"s{k % 7}" for k in range(390)] + [None] * 10
    pairs = [(k, "w " * int(rng.integers(0, 400)), s) for k, s in enumerate(names)]
    spark.createDataFrame(pairs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op7_mixing(spark, str(tmp_path)).collect()
    sizes = collections.Counter()
    for _, t, s in pairs:
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * sizes[s]) for s in order) < 1.5 * sum(sizes.values()) else (low, level)
    taken = collections.Counter()
    for r in got:
        s = names[r["doc_id"]]
        taken[s] += r["taken"]
        assert (r["size"], r["source_size"]) == (len(pairs[r["doc_id"]][1].split()), sizes[s]) and 0 <= r["taken"] <= 2 * r["size"]
        assert abs(r["target"] - min(low * weight[s], 2 * sizes[s])) < 1e-3
    assert all(abs(taken[s] - min(low * weight[s], 2 * sizes[s])) <= 0.01 * sizes[s] + 2 for s in order)


def brute_windows(pairs):
    n = collections.Counter(tuple(w[i : i + 35]) for _, t in pairs for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for k, t in pairs:
        w = words(t)
        gone = {j for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(want)


def test_op8(spark, corpus):
    got = substring_dedup.op8_substring_dedup(spark, corpus).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_windows(TEXTS)


@pytest.mark.parametrize("slice_cells", [16, 1024])
def test_op8_many_chunks_slices_and_buckets(spark, docs, slice_cells):
    """Many small chunks, slices and buckets, also with a sketch that is nearly full, give the same words."""
    got = substring_dedup.remove_repeats(docs, chunk_bytes=2000, slice_cells=slice_cells, bucket_words=100).collect()
    shown = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got)
    assert shown == brute_windows(TEXTS)


def test_op8_sizes_grow_with_the_words():
    """A sketch has two cells a word at any size; only the number of slices grows."""
    for n in (0, 10**6, 10**8, 10**9, 5 * 10**9, 10**13):
        slices, cells = substring_dedup.sketch_shape(n)
        assert cells <= substring_dedup.SLICE_CELLS and slices * cells >= 2 * n


def brute_winnow(text, gram=None, window=None):
    """The selected (hash, position) of a text: each gram hashed by itself, each window's least taken from the right."""
    gram, window = gram or fingerprint.GRAM, window or fingerprint.WINDOW
    parts = [text[i : i + gram] for i in range(len(text) - gram + 1)] or ([text] if text else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) >> 32 & 0x7FFFFFFF for p in parts]
    chosen = set()
    for s in range(max(len(hashes) - window + 1, min(len(hashes), 1))):
        own = range(s, min(s + window, len(hashes)))
        least = min(hashes[i] for i in own)
        i = max(i for i in own if hashes[i] == least)
        chosen.add((i, least))
    return [(h, i) for i, h in sorted(chosen)]


def test_op9(spark, corpus):
    got = fingerprint.op9_document_fingerprints(spark, corpus).collect()
    short = lambda t: t[:3000]  # noqa: E731 - the fingerprints of longer texts are compared below in another way
    order = sorted(TEXTS, key=lambda x: -x[0])
    seen = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in got}
    text = dict(TEXTS)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    shown = lambda x: ",".join(f"{h:x}@{i}" for h, i in x)
    assert len(got) == len(TEXTS) and sorted(r["doc_id"] for r in got) == sorted(k for k, _ in TEXTS)
    assert {k for k, _ in order} == set(text)
    distinct = sorted(text, reverse=True)
    for k, key in enumerate(distinct):
        t, x = text[key], text[distinct[(k + 1) % len(distinct)]]
        own = [r for r in got if r["doc_id"] == key]
        # Of equal ids the last is followed by another id; the others by an equal row.
        wanted = [(t, x)] if len(own) == 1 else [(t, t), (t, x)]
        found = []
        for t, x in wanted:
            edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
            r = seen[key, len(t), hashlib.sha256(edited.encode()).hexdigest()]
            found.append(r)
            if len(t) <= 3000 and len(x) <= 3000:
                a, b, c = brute_winnow(t), brute_winnow(edited), brute_winnow(short(x))
                hashes = [{h for h, _ in f} for f in (a, b, c)]
                assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(a), shown(b))
                assert abs(r["near_edited"] - jaccard(hashes[0], hashes[1])) < 1e-12
                assert abs(r["near_next"] - jaccard(hashes[0], hashes[2])) < 1e-12
        assert found


@pytest.mark.parametrize("script", ["abcdefgh ", "的一是不了人我在有他这中大来上𝒜"])
def test_winnowing_guarantee(spark, script):
    """A passage of WINDOW + GRAM - 1 characters is found at any offset, in spaced and unspaced text."""
    import random

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(script) for _ in range(n))
    shared = text(fingerprint.WINDOW + fingerprint.GRAM - 1)
    pairs = [(0, text(40) + shared + text(30)), *((1 + k, text(k) + shared + text(9)) for k in range(60))]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    longs = [r["fingerprint"] for r in fingerprint.fingerprints(df).orderBy("doc_id").collect()]
    found = [[(x >> 32, 0x7FFFFFFF - (x & 0x7FFFFFFF)) for x in own] for own in longs]
    assert all({h for h, _ in found[0]} & {h for h, _ in own} for own in found[1:])
    assert found == [brute_winnow(t) for _, t in pairs]


def test_repeated_text_takes_the_rightmost():
    assert [i for _, i in brute_winnow("a" * 100)] == list(range(fingerprint.WINDOW - 1, 100 - fingerprint.GRAM + 1))


def test_edited_fingerprints_are_those_of_the_edited_text(spark):
    """Texts of all lengths around a gram and a window, with next texts that are empty, short, long or beyond the first plane."""
    import random

    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abc 的𝒜\n") for _ in range(n))
    pairs = [(k, text(n), text(m)) for k, (n, m) in enumerate((n, m) for n in [*range(30), 40, 43, 44, 45, 80, 86, 87, 88, 90, 130, 300] for m in (0, 1, 7, 60, 200))]
    df = spark.createDataFrame([*pairs, (len(pairs), "a" * 200, "a" * 50)], "doc_id long, text string, next_text string")
    got = fingerprint.edited_fingerprints(df).orderBy("doc_id").select("doc_id", fingerprint.shown(F.col("fp")).alias("f"), fingerprint.shown(F.col("edited_fp")).alias("e")).collect()
    for k, t, x in pairs:
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        assert got[k]["doc_id"] == k
        assert (got[k]["f"], got[k]["e"]) == tuple(",".join(f"{h:x}@{i}" for h, i in brute_winnow(s)) for s in (t, edited)), (k, len(t), len(x))


def test_next_rows_over_many_ranges(spark):
    """The next row over ranges of ids and of hashes of rows without an id: one circle through all rows."""
    import random

    rng = random.Random(1)
    pairs = [(rng.choice([None, rng.randrange(50), rng.randrange(10**6)]), f"t{k}") for k in range(2000)]
    got = fingerprint.with_next(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5), "doc_id", "text").collect()
    after = {r["text"]: r["next_text"] for r in got}
    ids = {t: k for k, t in pairs}
    assert len(got) == len(pairs) == len(set(after.values()))
    at = start = next(t for t in after if ids[t] == max(k for k, _ in pairs if k is not None))
    seen = []
    while not seen or at != start:
        seen.append(ids[at])
        at = after[at]
    assert len(seen) == len(pairs)
    assert seen == sorted(seen, key=lambda k: (k is None, -(k or 0)))


def test_bounds_of_ranges_are_not_in_the_plan(spark):
    """The plan has as many expressions for sixteen times as many rows, and four times as many ranges; each row's range is found from literals alone."""
    sizes = []
    for n in (400, 6400):
        rows, _ = fingerprint.in_circle(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), "doc_id", "text")
        assert rows.agg(F.count_distinct("_range")).first()[0] >= 0.9 * math.isqrt(n)
        sizes.append(rows._jdf.queryExecution().analyzed().toString().count("from_json"))
        assert "from_json" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sizes[0] == sizes[1] > 0


def test_next_rows_with_a_hot_id(spark):
    """An id that holds a third of all rows spreads over ranges, and the rows stay in one order."""
    import random

    rng = random.Random(2)
    pairs = [(rng.choice([70, rng.randrange(140), rng.randrange(140)]), f"t{k}") for k in range(3000)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    rows, _ = fingerprint.in_circle(df, "doc_id", "text")
    sizes = {r["_range"]: r["n"] for r in rows.filter("_guest = 0").groupBy("_range").agg(F.count("*").alias("n"), F.max((F.col("doc_id") == 70).cast("int")).alias("hot")).filter("hot = 1").collect()}
    assert len(sizes) > 10 and max(sizes.values()) < 300
    tie = {r["text"]: r["t"] for r in df.select("text", F.bitwise_not(F.xxhash64("text")).alias("t")).collect()}
    order = [t for k, t in sorted(pairs, key=lambda x: (-x[0], -tie[x[1]]))]
    got = {r["text"]: r["next_text"] for r in fingerprint.with_next(df, "doc_id", "text").collect()}
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def brute_components(pairs):
    sets = {}
    for k, t in pairs:
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a]:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_op10(spark, corpus, docs):
    want = brute_components(TEXTS)
    got = near_dedup.op10_minhash_near_dedup(spark, corpus).collect()
    assert len(got) == len(TEXTS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    one = near_dedup.keep_one_each(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(k for k, v in want.items() if v[1] == k)


def test_op10_family_and_chain(spark):
    """A chain of near copies is one component; a family that only shares a passage is none."""
    from .conftest import prose

    base = prose(60, 100).split()
    chain = [" ".join([*base[k:], *prose(61, 100).split()[: k]]) for k in range(0, 40, 4)]
    family = [" ".join([*prose(70, 60).split(), *prose(71 + k, 40).split()]) for k in range(12)]
    pairs = list(enumerate(chain + family))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(df).collect()}
    assert got == brute_components(pairs)
    assert len({c for _, c in got.values()}) < len(pairs)


def test_op10_large_families(spark):
    """Families of hundreds, each copy edited in one to nine places, some of copies that are all too far from their original: no link is lost.

    Brute force counts shared shingles of all pairs by an inverted index. Measured recall of links is 1.
    """
    import random

    from .conftest import prose

    rng, pairs = random.Random(3), []
    for f in range(4):
        base = prose(900 + f, 110).split()
        for k in range(250):
            own = list(base)
            for _ in range(rng.randint(4, 9) if f == 3 else rng.randint(1, 9)):
                own[rng.randrange(len(own))] = prose(rng.randrange(10**6), 1)
            pairs.append((len(pairs), " ".join(own)))
    rng.shuffle(pairs)
    sets = {k: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)} for k, t in pairs}
    where, up, links = collections.defaultdict(list), {k: k for k in sets}, []

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sorted(sets):
        n = collections.Counter(b for s in sets[a] for b in where[s])
        links += [(a, b) for b, c in n.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
        for s in sets[a]:
            where[s].append(a)
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(pairs, "doc_id long, text string").repartition(8)).collect()}
    assert len(links) > 1000 and sum(got[a] == got[b] for a, b in links) == len(links)
    assert got == {k: find(k) for k in sets}
    assert sum(find(k) == k for k in sets) > 100


def test_op10_null_and_equal_ids(spark, tmp_path):
    """Rows are the nodes: no null id and no second text of an id is dropped unless it has a near duplicate that stays."""
    from .conftest import prose

    alone, same, family = prose(80, 60), [prose(81, 60), prose(82, 60)], prose(83, 60)
    pairs = [(None, alone), (None, prose(84, 60)), (None, None), (5, same[0]), (5, same[1]), (5, same[1]), (None, family), (7, family), (6, family + " end"), (None, prose(85, 60)), (None, prose(85, 60) + " end")]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_one_each(df).collect()), key=str)
    last = [p for p in kept if p in pairs[-2:]]
    assert len(last) == 1
    assert kept == sorted([(None, alone), pairs[1], (None, None), (5, same[0]), (5, same[1]), (6, family + " end"), *last], key=str)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = near_dedup.op10_minhash_near_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(pairs) and all(r["kept"] is not None for r in got)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0)] * 5 + [(0, 6)] + [(5, 5)] * 3 + [(6, 6), (7, 6)]
    assert sum(r["kept"] for r in got) == 8


LABELLED = "/root/testdata/sf0.01"


def auc(pairs):
    """The chance that a row of label 1 scores above one of label 0."""
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


def labelled(spark, label):
    if not os.path.isdir(LABELLED):
        pytest.skip("no labelled tables here")
    return {r[0]: r[1] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").select("doc_id", label).collect() if r[1] in (0, 1)}


def test_op1_held_out_accuracy(spark):
    known = labelled(spark, "toxic")
    got = toxicity.op1_toxicity(spark, LABELLED).collect()
    held = [(r["score"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 50 and auc(held) > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_op1_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 4, f"w{k} same") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    fed = []
    monkeypatch.setattr(toxicity, "train", lambda rows, y: fed.append((len(rows), sorted(y.tolist()))))
    toxicity.fit(docs, labels, F.lit(True), most=3)
    toxicity.fit(docs, labels, F.lit(True), most=1000)
    assert fed[0][0] == 3 and fed[1] == (200, [0.0] * 100 + [1.0] * 100)


def test_op6_rules_and_held_out_accuracy(spark):
    """Forest, path rules and lasso run on over 200 labelled rows; scores are those of the rules applied one by one."""
    known = labelled(spark, "quality")
    docs = documents(spark, LABELLED).select("doc_id", "text")
    measures = rule_ensemble.measured(docs).cache()
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet")
    ensemble = rule_ensemble.fit(measures, labels, ~rule_ensemble._held_out(F.col("_id")))
    assert len(known) > 200 and ensemble.rules and all(r.bounds and r.weight for r in ensemble.rules)
    rows = {r["doc_id"]: r for r in measures.select("*", ensemble.score().alias("score")).collect()}
    for r in rows.values():
        odds = ensemble.constant + sum(x.weight for x in ensemble.rules if all((r[n] <= v) if at_most else (r[n] > v) for n, at_most, v in x.bounds))
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-9
    held = [(r["score"], known[k]) for k, r in rows.items() if k in known and zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 30 and auc(held) > 0.8
