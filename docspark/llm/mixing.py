"""Mixing sources to target weights.

Each source's words, document after document, are cut into blocks of one length (to a word: a source's blocks differ by one word
at most). The mix is a list of shards of equal length; each shard draws how many of its slots every source fills.
A source's slots are numbered over all shards; slot numbers go through a pseudorandom permutation of
the source's block indexes, once for each pass over the source, and slots join blocks by index. A source's last slot takes as
many words of its block as the target still lacks.

A departure: shard counts are multinomial draws without replacement from the sources' slots. A shard's slots are a
random share of all slots, so the counts vary as in a multinomial and their sums are the slots that the targets ask for.
Independent draws would miss the targets by chance and could take a block more than twice.
The driver draws for groups of shards, each group's task for its shards.

Every source's order, blocks and slots are dealt by (source, part) or by group of shards, never by source alone: a source that holds
a third of all rows is as many groups as its rows call for. Equal rows are counted before anything is placed, and a count is
dealt in runs of ``RUN``: rows without an id, or a row that is there a million times, fill no task. What a source's rows need to know of it
comes with the sums of its parts. The driver holds a line for each source.

Defined results
* null text: size 0. Documents of size 0 are listed with 0 words taken.
* null source: a source of its own, last in order. Empty tables: an empty result.
* repeated rows and equal ids: each row has its own words and its own sum; which of equal rows gets which sum is not defined.
* null ids: ids like any other, last in a part's order.
* very long texts: a document spans many blocks; only block indexes are exploded.
* other columns, whatever their names, are ignored by the query and kept by ``mixed_documents``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import documents, materialize, text_or_empty, words

BLOCK_WORDS = 256
SHARD_SLOTS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_PASSES = 2
#: Counts that the driver draws at once, and slots for each task that makes them.
DRIVER_COUNTS, TASK_SLOTS = 100_000, 250_000
#: Most equal rows that are placed as one.
RUN = 1000
#: What is looked at of a draw's distribution: so many standard deviations, and counts, on both sides of its mode.
REACH = (10, 60)


@dataclass(frozen=True)
class Source:
    """One source of the mix: its name (None: null), its words, and the words the mix wants of it."""

    name: str | None
    size: int
    target: float

    def blocks(self, block: int = BLOCK_WORDS) -> int:
        return math.ceil(self.size / block)

    def slots(self, block: int = BLOCK_WORDS) -> tuple[int, int]:
        """How many slots the source fills, and how many words the last one takes."""
        n, want = self.blocks(block), min(round(self.target), MOST_PASSES * self.size)
        if not n or not want:
            return 0, 0
        passes, rest = divmod(want, self.size)
        more = rest * n // self.size
        part = round((rest * n - more * self.size) / n)
        full = passes * n + more
        return (full + 1, part) if part else (full, self.size // n + 1)


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> list[Source]:
    """Share ``share`` times all words by weight; no source gets over twice its size, the excess goes to the others."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(order))]
    open_, want = set(range(len(order))), [0.0] * len(order)
    left = share * sum(n for _, n in order)
    while open_:
        total = sum(weight[k] for k in open_)
        full = [k for k in open_ if left * weight[k] / total >= MOST_PASSES * order[k][1]]
        if not full:
            for k in open_:
                want[k] = left * weight[k] / total
            break
        for k in full:
            want[k] = float(MOST_PASSES * order[k][1])
        left -= sum(want[k] for k in full)
        open_ -= set(full)
    return [Source(name, n, want[k]) for k, (name, n) in enumerate(order)]


def shard_counts(quota: list[int], rng: np.random.Generator, lengths: list[int]) -> np.ndarray:
    """How many slots of each source every shard of these lengths holds: multinomial without replacement, a row for each shard."""
    left, rows = np.array(quota, dtype=np.int64), []
    for rest in lengths:
        # A draw without replacement, source by source: hypergeometric margins.
        drawn, pool = np.zeros(len(left), dtype=np.int64), int(left.sum())
        for j, have in enumerate(left.tolist()):
            pool -= have
            drawn[j] = rest if pool == 0 else have if have == 0 else _hypergeometric(rng, have, pool, rest)
            rest -= int(drawn[j])
        left -= drawn
        rows.append(drawn)
    return np.array(rows, dtype=np.int64).reshape(len(rows), len(quota))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from ``good`` and ``bad`` are good; by inversion, from the ratios of neighbouring probabilities, at any size."""
    low, high, pool = max(0, n - bad), min(n, good), good + bad
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (pool + 2)))
    reach = int(REACH[0] * math.sqrt(n * (good / pool) * (bad / pool) * ((pool - n) / (pool - 1)))) + REACH[1]
    first = max(low, mode - reach)
    k = np.arange(first, min(high, mode + reach), dtype=np.float64)
    rises = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([np.zeros(1), np.cumsum(rises)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + min(int(np.searchsorted(sums, rng.random() * sums[-1], side="right")), len(k))


def permuted(number: np.ndarray, blocks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The block of each slot number: pass by pass over a source, each pass a permutation of its blocks.

    A four-round Feistel network on the least even number of bits that holds all indexes, walked until the
    index is in range; it is its own function for every source and pass.
    """
    n, j = blocks.astype(np.uint64), number.astype(np.uint64)
    key = key.astype(np.uint64) + (j // n) * np.uint64(0x9E3779B97F4A7C15)
    half = (np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(np.float64))).astype(np.uint64) + np.uint64(2)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = j % n
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        k, h, m = key[todo], half[todo], mask[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            z = (right + k + np.uint64(turn)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z >> np.uint64(32)) & m)
        x[todo] = (left << h) | right
        todo &= x >= n
    return x.astype(np.int64)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def block_of(word: Column, base: Column, longer: Column) -> Column:
    """The block that holds a word; the first ``longer`` blocks have base + 1 words, the others base."""
    edge = longer * (base + 1)
    return F.when(word < edge, _div(word, base + 1)).otherwise(longer + _div(word - edge, base))


def block_begin(block: Column, base: Column, longer: Column) -> Column:
    return block * base + F.least(block, longer)


def block_words(block: Column, base: Column, longer: Column) -> Column:
    return base + (block < longer).cast("long")


def counted(rows: DataFrame, key: str, *ties: str) -> DataFrame:
    """Equal rows of (key, source, size, ...) as runs of ``n`` of them, at most ``RUN``; ``_part_key`` is a hash of the run."""
    own = [key, "source", "size", *ties]
    groups = rows.groupBy(*own).agg(F.count("*").alias("_n"))
    runs = groups.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("_n") - 1, F.lit(RUN)))))
    hashed = F.xxhash64(*(y for c in own for y in (F.col(c).isNull(), F.col(c))), "_run")
    return runs.select(*own, "_run", F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN).alias("_n"), hashed.alias("_part_key"))


def located(rows: DataFrame, key: str, *ties: str, block: int = BLOCK_WORDS) -> tuple[DataFrame, list[Source]]:
    """Add to rows (key, source, size, ...) the place ``start`` of their first word in their source, and what they need of the source; and the sources.

    Added are the source's number, size, target and block lengths. Prefix sums in two levels: parts of a source are summed, then runs of equal
    rows within a part; there are about as many parts as runs in a part.
    """
    spark = rows.sparkSession
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source")  # null apart from every name
    runs = materialize(counted(rows, key, *ties).select("*", named), "mix-sizes")
    parts = max(1, math.isqrt(runs.count()))
    runs = runs.withColumn("_part", F.pmod("_part_key", F.lit(parts)).cast("int"))
    words_of = F.col("size") * F.col("_n")
    sums = runs.groupBy("_source", "_part").agg(F.first("source").alias("source"), F.sum(words_of).alias("_sum"))
    sources = targets([(r["source"], int(r["n"])) for r in sums.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_sum").alias("n")).collect()])
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_source", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    facts = [("n" if s.name is None else f"s{s.name}", j, s.size, s.target, s.size // n if (n := s.blocks(block)) else 1, s.size % n if n else 0) for j, s in enumerate(sources)]
    known = bases.join(spark.createDataFrame(facts, "_source string, source_no int, source_size long, target double, _base long, _longer long"), "_source")
    within = Window.partitionBy("_source", "_part").orderBy(F.col(key).asc_nulls_last(), "size", *ties, "_run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_in", F.coalesce(F.sum(words_of).over(within), F.lit(0))).join(known, ["_source", "_part"])
    each = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("_before") + F.col("_in") + F.col("_i") * F.col("size")
    return each.withColumn("start", start).drop("_source", "_part", "_part_key", "_run", "_n", "_in", "_i", "_before"), sources


def slots(spark: SparkSession, sources: list[Source], seed: int, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, driver_counts: int = DRIVER_COUNTS) -> DataFrame:
    """The mix: a row (shard, source_no, block, n_words) for each slot; ``n_words`` are those it takes of its block, null for all."""
    asked = [s.slots(block) for s in sources]
    quota = [q for q, _ in asked]
    total = sum(quota)
    shards = math.ceil(total / shard_slots)
    groups = max(1, min(shards, driver_counts // max(1, len(sources))))
    per = math.ceil(shards / groups) if shards else 1
    firsts = list(range(0, shards, per))
    counts = shard_counts(quota, np.random.default_rng(seed), [min(total, (f + per) * shard_slots) - f * shard_slots for f in firsts])
    begin = np.cumsum(counts, axis=0) - counts
    table = [(f, begin[k].tolist(), counts[k].tolist()) for k, f in enumerate(firsts)]
    keys = np.array([zlib.crc32(repr(s.name).encode()) + seed for s in sources], dtype=np.int64)
    blocks = np.array([s.blocks(block) for s in sources], dtype=np.int64)
    last, part = np.array([q - 1 for q in quota]), np.array([p for _, p in asked])
    whole = np.array([s.size // n if (n := s.blocks(block)) else 0 for s in sources]) < part

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, at, own in zip(*(batch.column(c).to_pylist() for c in ("first", "at", "own")), strict=True):
                at, lengths = np.array(at, dtype=np.int64), [min(total, (k + 1) * shard_slots) - k * shard_slots for k in range(first, min(shards, first + per))]
                for k, counts in enumerate(shard_counts(own, np.random.default_rng((seed, first + 1)), lengths)):
                    source = np.repeat(np.arange(len(own)), counts)
                    number = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + at[source]
                    at = at + counts
                    n_words = pa.array(part[source], pa.int64(), mask=(number != last[source]) | whole[source])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(source), first + k), pa.int64()), pa.array(source, pa.int32()), pa.array(permuted(number, blocks[source], keys[source]), pa.int64()), n_words],
                        names=["shard", "source_no", "block", "n_words"],
                    )

    dealt = spark.createDataFrame(table, "first long, at array<long>, own array<long>").repartition(max(1, min(len(table), total // TASK_SLOTS)), "first")
    return dealt.mapInArrow(made, "shard long, source_no int, block long, n_words long")


def taken_blocks(rows: DataFrame, sources: list[Source], seed: int, block: int = BLOCK_WORDS) -> DataFrame:
    """Rows (source_no, start, begin, n_words, takes) of the ``located`` rows.

    There is one for each block that a row has words in and the mix takes: the place of the block's first word, its
    words, and for each time it is taken how many of them from the first, most first.
    """
    drawn = slots(rows.sparkSession, sources, seed, block).groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.coalesce("n_words", F.lit(1 << 40))), asc=False).alias("takes"))
    base, longer = F.col("_base"), F.col("_longer")
    first, last = block_of(F.col("start"), base, longer), block_of(F.col("start") + F.col("size") - 1, base, longer)
    pieces = rows.filter("size > 0").select("source_no", "start", "_base", "_longer", F.explode(F.sequence(first, last)).alias("block"))
    begin, n = block_begin(F.col("block"), base, longer), block_words(F.col("block"), base, longer)
    return pieces.join(drawn, ["source_no", "block"]).select("source_no", "start", begin.alias("begin"), F.transform("takes", lambda x: F.least(x, n)).alias("takes"))


def taken(rows: DataFrame, sources: list[Source], seed: int, block: int = BLOCK_WORDS) -> DataFrame:
    """Add to ``located`` rows ``taken``, the words of each row that the mix takes."""
    got = taken_blocks(rows, sources, seed, block)
    of = rows.filter("size > 0").select("source_no", "start", "size")
    end = F.col("start") + F.col("size")
    words_of = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(0), F.least(end, F.col("begin") + x) - F.greatest("start", "begin")))
    sums = got.join(of, ["source_no", "start"]).groupBy(F.col("source_no").alias("_no"), F.col("start").alias("_start")).agg(F.sum(words_of).alias("taken"))
    joined = rows.join(sums, (F.col("source_no") == F.col("_no")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return joined.withColumn("taken", F.coalesce("taken", F.lit(0))).drop("_no", "_start", "source_no", "_base", "_longer")


def _row_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of a row's columns, null apart; maps, which have no hash, by their JSON text."""
    plain = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    return F.xxhash64(F.lit(seed), *(y for c in plain for y in (c.isNull(), c)))


def placed_documents(docs: DataFrame, key: str, text: str, block: int = BLOCK_WORDS) -> tuple[DataFrame, list[Source]]:
    """The ``located`` rows (_key, source, size, _row_0, _row_1, ...) of documents, and the sources; two hashes stand for a row."""
    size = F.size(words(text_or_empty(text))).cast("long").alias("size")
    small = docs.select(F.col(key).alias("_key"), "source", size, *(_row_hash(docs, k).alias(f"_row_{k}") for k in range(2)))
    return located(small, "_key", "_row_0", "_row_1", block=block)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, block: int = BLOCK_WORDS) -> DataFrame:
    """The documents as the mix takes them; their columns are those of ``docs``.

    A document is there once for each pass that takes words of it, with the words taken: unchanged where that is all of
    them, else the words of the blocks taken, with single spaces. ``n_chars``, where there is one, is renewed.

    All placing is done on two hashes of the row, its source and its size; the texts are shuffled once, to meet the blocks taken of them. Of rows
    that agree in all columns, one brings its text for all of them, and the tasks that read them leave one each.
    """
    rows, sources = placed_documents(docs, key, text, block)
    passes = taken_blocks(rows, sources, seed, block).groupBy("source_no", "start").agg(F.array_sort(F.collect_list(F.struct("begin", "takes"))).alias("_got"))
    met = rows.filter("size > 0").join(passes, ["source_no", "start"]).select("_row_0", "_row_1", "start", "size", "_got")
    full = docs.select(F.struct(*docs.columns).alias("_doc"), *(_row_hash(docs, k).alias(f"_row_{k}") for k in range(2))).dropDuplicates(["_row_0", "_row_1"])
    joined = full.join(met, ["_row_0", "_row_1"]).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))))
    inside = F.transform(
        F.filter("_got", lambda x: F.size(x["takes"]) > F.col("_pass")),
        lambda x: F.struct(
            F.greatest(x["begin"] - F.col("start"), F.lit(0)).alias("a"), F.least(x["begin"] + F.get(x["takes"], F.col("_pass")) - F.col("start"), F.col("size")).alias("b")
        ),
    )
    joined = joined.withColumn("_cut", F.filter(inside, lambda x: x["a"] < x["b"])).filter(F.size("_cut") > 0)
    whole = F.aggregate("_cut", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]) == F.col("size")
    own = words(F.col("_doc")[text])
    cut = F.array_join(F.flatten(F.transform("_cut", lambda x: F.slice(F.col("_own"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))), " ")
    joined = joined.withColumn("_own", F.when(~whole, own)).withColumn("_new", F.when(F.col("_own").isNull(), F.col("_doc")[text]).otherwise(cut))
    renewed = {text: F.col("_new")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.char_length("_new").cast(docs.schema["n_chars"].dataType)
    return joined.select(*(renewed.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = taken(*placed_documents(documents(spark, sf_dir), "doc_id", "text"), seed)
    return mixed.select(F.col("_key").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
