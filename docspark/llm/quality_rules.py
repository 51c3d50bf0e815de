"""Quality rules under weak supervision [native].

Each rule votes good (1), bad (-1) or abstains (0) on a document. Nobody has labelled the
documents, so the rules' reliabilities are estimated from how they agree: a two-class latent
model (Dawid and Skene) fitted by expectation-maximisation. A document's verdict is its
posterior probability of being good.

All document statistics are Spark column expressions. The fit needs only the number of documents
for each combination of votes, at most 3 ** len(RULES) rows (a few hundred in practice) whatever the size of the corpus; that
small table is what the driver sees.

Defined results
* null text: no words, no lines; all counts are 0, it fails the base rule and is not kept.
* empty table: an empty result; the model keeps its starting values.
* repeated rows and ties: each row is judged by itself and counted once in the fit.
* very long texts: all work is linear in the text, but for sorting the windows of documents
  that repeat windows.
* other columns of the input, whatever their names, are carried through ``keep_good``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import documents, materialize, text_or_empty, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
STATS = "_quality_stats"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, text: str = "text", into: str = STATS) -> DataFrame:
    """Add the struct column ``into`` with the counts that the rules look at."""
    names = {x: f"{into}_{x}" for x in ("t", "w", "g", "s", "p", "lines")}
    t, w, g, s, p, lines = (F.col(names[x]) for x in ("t", "w", "g", "s", "p", "lines"))
    n = F.size(w)
    out = docs.withColumn(names["t"], text_or_empty(text))
    out = out.withColumns(
        {
            names["w"]: words(t),
            names["lines"]: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    gram = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
    )
    out = out.withColumn(names["g"], F.when(n >= WINDOW, gram).otherwise(F.array().cast("array<bigint>")))
    # Only documents that repeat a window sort their windows; equal neighbours are repeats.
    placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(
        names["s"], F.when(F.size(F.array_distinct(g)) < F.size(g), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    )
    same = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
    out = out.withColumn(names["p"], F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    stats = F.struct(
        n.cast("bigint").alias("n_words"),
        (F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"""[.!?:;"'…。][)"'”»\x20\r]*$"""))).cast("bigint").alias("n_ended_lines"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        F.regexp_count(t, F.lit("[!?]")).cast("bigint").alias("n_shouts"),
        F.regexp_count(t, F.lit("[0-9]")).cast("bigint").alias("n_digits"),
        F.regexp_count(t, F.lit(r"(?<=[^\x20\x09-\x0D])[.!?;:。][)\"'”»]?(?![^\x20\x09-\x0D])")).cast("bigint").alias("n_stops"),
        F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
    )
    # A generator keeps filters on the counts from being pushed below and spelled out again for every count they read.
    return out.select("*", F.explode(F.array(stats)).alias(into)).drop(*names.values())


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


#: Each rule: name, a measure of the statistics, when it votes good, when it votes bad.
#: Between the two it abstains. The thresholds are those in common use for web text.
RULES = (
    ("length", lambda s: s["n_words"], lambda x: x >= 50, lambda x: x < MIN_WORDS),
    ("word_length", lambda s: _ratio(s["word_chars"], s["n_words"]), lambda x: (x >= 3) & (x <= 10), lambda x: (x < 2) | (x > 14)),
    ("symbols", lambda s: _ratio(s["n_symbols"], s["n_words"]), lambda x: x < 0.05, lambda x: x > 0.2),
    ("symbol_share", lambda s: _ratio(s["n_symbols"], s["word_chars"]), lambda x: x < 0.02, lambda x: x > 0.1),
    ("sentences", lambda s: _ratio(s["n_stops"], s["n_words"]), lambda x: (x >= 0.03) & (x <= 0.25), lambda x: x < 0.01),
    ("duplicate_lines", lambda s: _ratio(s["n_dup_lines"], s["n_lines"]), lambda x: x < 0.05, lambda x: x > 0.3),
    ("repeated_windows", lambda s: _ratio(s["n_repeat_words"], s["n_words"]), lambda x: x < 0.05, lambda x: x > 0.2),
    ("capitals", lambda s: _ratio(s["n_capitals"], s["word_chars"]), lambda x: x < 0.15, lambda x: x > 0.4),
    ("shouting", lambda s: _ratio(s["n_shouts"], s["n_words"]), lambda x: x < 0.1, lambda x: x > 0.5),
    ("digits", lambda s: _ratio(s["n_digits"], s["word_chars"]), lambda x: x < 0.1, lambda x: x > 0.3),
    ("line_ends", lambda s: _ratio(s["n_ended_lines"], s["n_lines"]), lambda x: x > 0.6, lambda x: x < 0.1),
    ("variety", lambda s: _ratio(s["n_distinct_words"], s["n_words"]), lambda x: x > 0.15, lambda x: x < 0.05),
)


def votes(stats: Column) -> Column:
    """A struct with one vote, 1, -1 or 0, for each rule."""
    return F.struct(*(F.when(good(measure(stats)), 1).when(bad(measure(stats)), -1).otherwise(0).alias(name) for name, measure, good, bad in RULES))


def base_failed(stats: Column) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


@dataclass(frozen=True)
class VoteModel:
    """Prior of good; for each rule, the chance of a good vote on good and of a bad one on bad documents."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, vote: Column) -> Column:
        """The probability that a document with these votes is good."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for (name, *_), a, b in zip(RULES, self.on_good, self.on_bad, strict=True):
            odds = odds + F.when(vote[name] == 1, math.log(a / (1 - b))).when(vote[name] == -1, math.log((1 - a) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    The start (rules right four times in five, most documents good) settles which class is
    called good. Reliabilities stay below 0.995, so that no single rule decides alone, and no vote
    is ever turned round: a rule that votes good on both classes alike counts for nothing.
    """
    m = len(RULES)
    prior, good, bad = 0.8, [0.8] * m, [0.8] * m
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        of_good, hit, seen, hit_bad, seen_bad = 0.0, [0.0] * m, [0.0] * m, [0.0] * m, [0.0] * m
        for vote, count in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(vote):
                odds += math.log(good[j] / (1 - bad[j])) if v == 1 else math.log((1 - good[j]) / bad[j]) if v == -1 else 0.0
            q = count / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            of_good += q
            for j, v in enumerate(vote):
                if v:
                    seen[j] += q
                    seen_bad[j] += count - q
                    hit[j] += q * (v == 1)
                    hit_bad[j] += (count - q) * (v == -1)
        before = (prior, good, bad)
        prior = max(0.05, min(0.95, of_good / total))
        good = [max(0.5, min(0.995, (4 + a) / (5 + b))) for a, b in zip(hit, seen, strict=True)]
        bad = [max(1 - g, min(0.995, (4 + a) / (5 + b))) for a, b, g in zip(hit_bad, seen_bad, good, strict=True)]
        moved = max(abs(prior - before[0]), *(abs(x - y) for x, y in zip(good + bad, before[1] + before[2], strict=True)))
        if moved < 1e-7:
            break
    return VoteModel(prior, tuple(good), tuple(bad))


def fit(with_stats: DataFrame, stats: str = STATS) -> VoteModel:
    """Count the vote patterns of all documents and fit the model to the counts."""
    vote = votes(F.col(stats))
    names = [name for name, *_ in RULES]
    counted = with_stats.select(vote.alias("v")).select("v.*").groupBy(*names).count().collect()
    return fit_votes(sorted((tuple(r[n] for n in names), r["count"]) for r in counted))


def keep_good(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """The documents that pass the base rule and that the votes call good; all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text"))
    stats = F.col(STATS)
    # Counting is the costly part: the documents are written once with their counts, which the fit and the verdict read.
    counted = materialize(text_statistics(rows).select("_doc", STATS), "quality-counted")
    good = ~base_failed(stats) & (fit(counted).posterior(votes(stats)) >= min_posterior)
    return counted.filter(good).select("_doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str, min_posterior: float = 0.5) -> DataFrame:
    """The verdict on every document, with its counts and posterior."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    stats = materialize(text_statistics(docs).select("doc_id", STATS), "quality-stats")
    posterior = fit(stats).posterior(votes(F.col(STATS)))
    failed = base_failed(F.col(STATS))
    return stats.select(
        "doc_id",
        *(F.col(f"{STATS}.{c}") for c in COUNTS),
        failed.alias("base_failed"),
        (~failed & (posterior >= min_posterior)).alias("kept"),
        posterior.alias("quality_posterior"),
    )
