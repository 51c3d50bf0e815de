"""Quality classifier: an ensemble of rules over text statistics.

Shallow trees of a random forest propose rules: each path from a root to a node is a conjunction of bounds on statistics of
a text (shares of symbols, capitals, repeated lines and so on). A logistic regression with lasso penalty weighs the rules and
leaves most at 0; those that stay are compiled into one Spark column expression. What scores a document is thus a short list of
readable conditions, evaluated where the document is.

Statistics of all documents are computed once and written, without texts; the fit takes at most ``MAX_SAMPLE`` labelled rows,
those of least hash of id.

Defined results
* null and empty texts: statistics of 0, scored like any other.
* labels: rows without a 0 or 1 label, or whose document is missing, are no training rows. Without training rows of both
  labels every score is the share of label 1 among them (0.5 without any), smoothed.
* repeated rows: scored alike; repeated labels count as often as they stand there, up to the bound. Ties in a statistic
  fall on the same side of a bound.
* very long texts: linear time. Empty tables: an empty result.
* other columns, whatever their names, are ignored: only the text is an input of a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import documents, materialize
from docspark.llm.quality_rules import STATS, text_statistics

MAX_SAMPLE = 20_000
TREES, DEPTH = 15, 3
LASSO = 0.002
SEED = 6


def _ratio(a: str, b: str) -> Column:
    return F.col(f"{STATS}.{a}") / F.greatest(F.col(f"{STATS}.{b}"), F.lit(1))


#: What rules may speak of: name and measure.
MEASURES = (
    ("words", lambda: F.col(f"{STATS}.n_words").cast("double")),
    ("lines", lambda: F.col(f"{STATS}.n_lines").cast("double")),
    ("word_length", lambda: _ratio("word_chars", "n_words")),
    ("symbols_per_word", lambda: _ratio("n_symbols", "n_words")),
    ("duplicate_lines", lambda: _ratio("n_dup_lines", "n_lines")),
    ("repeated_words", lambda: _ratio("n_repeat_words", "n_words")),
    ("ended_lines", lambda: _ratio("n_ended_lines", "n_lines")),
    ("capitals", lambda: _ratio("n_capitals", "word_chars")),
    ("shouts_per_word", lambda: _ratio("n_shouts", "n_words")),
    ("digits", lambda: _ratio("n_digits", "word_chars")),
    ("stops_per_word", lambda: _ratio("n_stops", "n_words")),
    ("distinct_words", lambda: _ratio("n_distinct_words", "n_words")),
    ("words_per_line", lambda: _ratio("n_words", "n_lines")),
)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds (measure, at most or above, value), and its weight."""

    bounds: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        out = F.lit(True)
        for name, at_most, value in self.bounds:
            out = out & ((F.col(name) <= value) if at_most else (F.col(name) > value))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {'<=' if at_most else '>'} {value:g}" for name, at_most, value in self.bounds)


@dataclass(frozen=True)
class Ensemble:
    """The constant and the weighted rules."""

    constant: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """The probability of label 1, over the columns of ``measured``."""
        odds = F.lit(self.constant)
        for r in self.rules:
            odds = odds + F.when(r.holds(), r.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and a column for each measure of ``text``."""
    return text_statistics(docs).select(*keep, *(m().alias(name) for name, m in MEASURES))


def tree_rules(model) -> list[Rule]:  # noqa: ANN001
    """The paths from the roots of a fitted forest to all their nodes, each once, in order of appearance."""
    found: dict[tuple, Rule] = {}

    def walk(node, bounds: tuple) -> None:  # noqa: ANN001
        if bounds:
            tight: dict[tuple[str, bool], float] = {}
            for name, at_most, value in bounds:
                had = tight.get((name, at_most), value)
                tight[name, at_most] = min(had, value) if at_most else max(had, value)
            own = tuple(sorted((n, a, v) for (n, a), v in tight.items()))
            found.setdefault(own, Rule(own))
        if node.getClass().getSimpleName() == "InternalNode":
            name, value = MEASURES[node.split().featureIndex()][0], float(node.split().threshold())
            walk(node.leftChild(), (*bounds, (name, True, value)))
            walk(node.rightChild(), (*bounds, (name, False, value)))

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), ())
    return list(found.values())


def fit(measures: DataFrame, labels: DataFrame, training: Column, label: str = "quality", key: str = "doc_id", most: int = MAX_SAMPLE) -> Ensemble:
    """Propose rules by trees and weigh them by a lasso, on a bounded sample of the training part of ``labels``."""
    chosen = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).filter(training)
    chosen = chosen.withColumn("_at", F.xxhash64("_id")).orderBy("_at", "_id", "label").limit(most)
    rows = materialize(measures.join(F.broadcast(chosen), F.col(key) == F.col("_id")).drop(key, "_id").orderBy("_at").limit(most), "rule-sample")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, all_ = counts.get(1, 0), sum(counts.values())
    if len(counts) < 2:
        share = (ones + 1) / (all_ + 2)
        return Ensemble(_log_odds(share), ())
    names = [name for name, _ in MEASURES]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5).fit(vectors)
    rules = tree_rules(forest)
    if not rules:
        return Ensemble(_log_odds((ones + 1) / (all_ + 2)), ())
    marked = rows.select("label", *(F.when(r.holds(), 1.0).otherwise(0.0).alias(f"r{k}") for k, r in enumerate(rules)))
    marked = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(marked).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(marked)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(float(lasso.intercept), tuple(Rule(r.bounds, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def _log_odds(share: float) -> float:
    return math.log(share / (1 - share))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; rows with crc32(doc_id) mod 5 = 0 are held out of training."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measures = materialize(measured(docs), "rule-measures")
    ensemble = fit(measures, labels, ~_held_out(F.col("_id")))
    scored = measures.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), ensemble.score().alias("score"))
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
