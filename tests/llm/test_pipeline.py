"""The stages of the pipeline in order, each against what it must do to its own input."""

import collections

import corpus_pipeline as pipeline
from docspark.llm import mixing, packing
from docspark.llm.common import materialize
from docspark.llm.quality_rules import op5_quality_rules

from .test_ops import brute_components, brute_lines, words


def test_stages(spark, corpus, docs):
    before, columns = docs, docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        after = materialize(stage(spark, before, corpus), "test-" + name.replace(" ", "-"))
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name != "packing":
            assert after.columns == columns
            got = [(r["doc_id"], r["text"]) for r in after.collect()]
        if name == "quality rules":
            verdicts = collections.Counter(r["doc_id"] for r in op5_quality_rules(spark, corpus).collect() if r["kept"])
            assert collections.Counter(k for k, _ in got) == verdicts and not collections.Counter(got) - collections.Counter(rows)
        if name == "line dedup":
            want = brute_lines(rows)
            assert sorted(got, key=str) == sorted(((k, None if t is None else "\n".join(want[k, t])) for k, t in rows), key=str)
        if name == "near dedup":
            want = brute_components([(k, t or "") for k, t in rows])
            assert sorted(k for k, _ in got) == sorted(k for k, v in want.items() if v[1] == k)
        if name == "mixing":
            sizes, sources, taken = collections.Counter(), {r["doc_id"]: r["source"] for r in before.collect()}, collections.Counter()
            for k, t in rows:
                sizes[sources[k]] += len(words(t or ""))
            for k, t in got:
                own = words(dict(rows)[k])
                assert all(w in own for w in words(t)) and len(words(t)) <= len(own)
                taken[sources[k]] += len(words(t))
            assert max(collections.Counter(k for k, _ in got).values()) <= mixing.MOST_PASSES
            assert all(abs(taken[s.name] - s.target) <= 0.01 * s.size + 2 for s in mixing.targets(list(sizes.items())))
        if name == "packing":
            pieces = after.collect()
            assert {r["doc_id"] for r in pieces} == {k for k, _ in rows}
            once = {k: r for r in packing.pack(before.dropDuplicates(["doc_id"]), packing.default_ranks()).collect() for k in [r["doc_id"]]}
            assert all(once[k]["doc_tokens"] > 0 for k in once)
            ends = collections.defaultdict(list)
            for r in pieces:
                ends[r["sequence_id"]].append((r["offset"], r["length"]))
            assert all(a + n == b for own in ends.values() for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))
            assert all(sum(n for _, n in own) <= 2048 for own in ends.values())
        seen[name] = after.count()
        before = after
    assert list(seen) == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]


def test_empty_tables(spark, empty):
    assert pipeline.run(spark, empty).collect() == []


def test_run(spark, corpus):
    """The whole run ends in pieces of documents that the rules keep."""
    kept = {r["doc_id"] for r in op5_quality_rules(spark, corpus).collect() if r["kept"]}
    found = {r["doc_id"] for r in pipeline.run(spark, corpus).collect()}
    assert found and found <= kept
