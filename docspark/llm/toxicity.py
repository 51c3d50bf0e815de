"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: every word in lower case, and its first four and five letters, which is what
inflected and compounded words of one stem share. Terms are hashed into ``BUCKETS`` buckets. The machine scores a
text by a weight for each term and, for each pair of terms, the product of their factors: pairs
that are toxic only together (an insult and the mention of a group) are learnt, which sums of weights miss.

Training takes at most ``MAX_SAMPLE`` labelled rows, those of least hash of id, so that two fits agree. Terms are kept for the fit for what they tell
alone, or in a pair with another of the ``PAIR_TERMS`` commonest terms; both are parameters of the fit. Scoring is one pass over the texts without a shuffle.

Defined results
* null and empty texts: no terms; the score of the machine's constant alone.
* labels: rows without a 0 or 1 label, without an id, or whose document is missing, are no training rows; labels of one id that differ are rows each. Without any training row all
  scores are 0.5. With labels of one kind only, the constant is all that is learnt.
* repeated rows: each is scored alike; repeated labels and ids count as often as they stand there, up to the bound.
* very long texts: terms are counted once each, linear time. Empty tables: an empty result.
* other columns, whatever their names, are ignored: only the text is an input of a score.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import discard, documents, materialize, text_or_empty

BUCKETS = 1 << 18
FACTORS = 4
MAX_SAMPLE = 20_000
#: Terms in fewer training rows are left out of the fit, and so are those that differ between the classes by fewer standard errors, taken
#: alone and in all pairs: most of the many terms differ by chance, and a machine given all of them learns its rows by heart.
LEAST_ROWS = 3
LEAST_ERRORS = 3.5
#: Pairs among the so many commonest terms of the training rows are looked at; there are half a million, so more errors are asked of them.
PAIR_TERMS = 1024
LEAST_PAIR_ERRORS = 6.0
ROUNDS = 200
SEED = 11
_WORD = re.compile(r"[^\W\d_]+")


class Terms:
    """Hashed terms of texts, with a memory of the words met in this task."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> np.ndarray:
        found: set[int] = set()
        for w in set(_WORD.findall(text.lower())):
            own = self.known.get(w)
            if own is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                own = self.known[w] = tuple({xxhash.xxh3_64_intdigest(t) % BUCKETS for t in ("=" + w, "4" + w[:4], "5" + w[:5])})
            found.update(own)
        return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass
class Machine:
    """Constant, weights and factors of the kept buckets; buckets that were left out stand at 0."""

    constant: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows; empty stretches sum to 0."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def margins(flat: np.ndarray, bounds: np.ndarray, constant: float, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and each row's sum of factors."""
    v = factors[flat].astype(np.float64)
    summed = _sums(v, bounds)
    return constant + _sums(weights[flat], bounds) + 0.5 * (summed**2 - _sums(v * v, bounds)).sum(axis=1), summed


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def paired(rows: list[np.ndarray], labels: np.ndarray, counts: np.ndarray, most: int = PAIR_TERMS) -> np.ndarray:
    """The terms that matter in a pair: the rows with both are toxic more or less often than the effects of either alone add up to.

    Only such terms can be missed by a look at each alone, as when two terms are toxic together and apart but either one's share is as usual.
    """
    common = np.argsort(-counts, kind="stable")[:most]
    common = np.sort(common[counts[common] >= LEAST_ROWS])
    both, toxic = np.zeros((2, len(common), len(common)))
    for at in range(0, len(rows), 1024):
        own = rows[at : at + 1024]
        flat, of = np.concatenate(own), np.repeat(np.arange(len(own)), [len(r) for r in own])
        place = np.searchsorted(common, flat)
        held = common[np.minimum(place, len(common) - 1)] == flat if len(common) else np.zeros(len(flat), dtype=bool)
        x = np.zeros((len(own), len(common)), dtype=np.float32)
        x[of[held], place[held]] = 1
        both += x.T @ x
        toxic += x.T @ (x * labels[at : at + 1024, None].astype(np.float32))
    share = (np.diag(toxic) + 0.5) / (np.diag(both) + 1)
    expected = logistic(_logit(share)[:, None] + _logit(share)[None, :] - _logit((labels.sum() + 0.5) / (len(labels) + 1)))
    errors = np.abs(toxic - both * expected) / np.sqrt(np.maximum(both * expected * (1 - expected), 1.0))
    np.fill_diagonal(errors, 0)
    return common[(errors >= LEAST_PAIR_ERRORS).any(axis=1)] if len(common) else common


def train(rows: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Machine:
    """Fit by Adagrad on the logistic loss, with ridge penalties that keep unneeded terms near 0."""
    if not len(rows):
        return Machine(0.0, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    toxic = np.bincount(np.concatenate(rows), weights=np.repeat(labels, [len(r) for r in rows]), minlength=BUCKETS)
    overall = labels.mean()
    errors = np.abs(toxic - counts * overall) / np.sqrt(np.maximum(counts * overall * (1 - overall), 1e-9))
    kept = np.union1d(np.flatnonzero((counts >= LEAST_ROWS) & (errors >= LEAST_ERRORS)), paired(rows, labels, counts))
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    share = (labels.sum() + 1) / (len(labels) + 2)
    constant, w, v = float(np.log(share / (1 - share))), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS))
    gc, gw, gv = 1e-6, np.full(len(kept), 1e-6), np.full(v.shape, 1e-6)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            own = order[at : at + 256]
            flat = np.concatenate([rows[k] for k in own])
            bounds = np.concatenate(([0], np.cumsum([len(rows[k]) for k in own])))
            margin, summed = margins(flat, bounds, constant, w, v)
            error = (logistic(margin) - labels[own]) / len(own)
            each = np.repeat(error, np.diff(bounds))
            touched, inverse = np.unique(flat, return_inverse=True)
            dw = np.bincount(inverse, weights=each, minlength=len(touched)) + 1e-5 * w[touched]
            slope = each[:, None] * (np.repeat(summed, np.diff(bounds), axis=0) - v[flat])
            dv = np.stack([np.bincount(inverse, weights=slope[:, k], minlength=len(touched)) for k in range(FACTORS)], axis=1) + 1e-4 * v[touched]
            dc = float(error.sum())
            gc, gw[touched], gv[touched] = gc + dc * dc, gw[touched] + dw * dw, gv[touched] + dv * dv
            constant -= 0.1 * dc / gc**0.5
            w[touched] -= 0.15 * dw / np.sqrt(gw[touched])
            v[touched] -= 0.02 * dv / np.sqrt(gv[touched])
    return Machine(constant, kept, w, v)


def sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, key: str = "doc_id", most: int = MAX_SAMPLE) -> DataFrame:
    """At most ``most`` labelled rows (label, text) of the training part, those of least hash of the id.

    The cut is made on ids and labels alone; only the rows chosen fetch their texts.
    """
    chosen = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    chosen = chosen.filter(training).withColumn("_at", F.xxhash64("_id")).orderBy("_at", "_id", "label").limit(most)
    texts = docs.select(F.col(key).alias("_key"), text_or_empty("text").alias("text"))  # other columns may be named as the labels' are
    return texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("label", "text", "_at")


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", most: int = MAX_SAMPLE) -> Machine:
    """Train on a bounded sample of ``most`` rows. Its term sets are made on the executors; the driver fits the machine."""
    rows = sample(docs, labels, label, training, most=most)

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [np.sort(terms(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("_at"), pa.array(found, pa.binary())], names=["label", "_at", "terms"])

    # Repeated ids may bring more rows than were chosen. All are written in one job; a hash of the row then leaves few more than ``most``, and
    # the driver, which reads them in a few parts, holds the least ``most``.
    found = materialize(rows.mapInArrow(termed, "label int, _at long, terms binary"), "toxic-sample")
    n = found.count()
    few = found if n <= 2 * most else found.filter(F.pmod(F.xxhash64("_at", "label", "terms"), F.lit(1 << 30)) < int((1 << 30) * (1.1 * most + 1000) / n))
    got = heapq.nsmallest(most, ((r["_at"], r["label"], bytes(r["terms"])) for r in few.coalesce(8).toLocalIterator()))
    discard(found)
    return train([np.frombuffer(t, dtype=np.int32).astype(np.int64) for _, _, t in got], np.array([y for _, y, _ in got], dtype=np.float64))


def scored(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score``, the probability of toxic, for each document."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.constant, machine.buckets, machine.weights, machine.factors))  # at most BUCKETS rows
    rows = docs.select(*keep, text_or_empty(text).alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, (constant, buckets, own_weights, own_factors) = Terms(), sent.value
        weights, factors = np.zeros(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, own_factors.shape[1]), dtype=np.float32)
        weights[buckets], factors[buckets] = own_weights, own_factors
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [terms(t) for t in part.column("_text").to_pylist()]
                flat = np.concatenate(own)
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in own])))
                margin, _ = margins(flat, bounds, constant, weights, factors)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(logistic(margin))], names=[*keep, "score"])

    return rows.mapInArrow(score, f"{schema}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; rows with crc32(doc_id) mod 3 = 1 are held out of training."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = fit(docs, labels, ~held_out(F.col("_id"), 3, 1))
    return scored(docs, machine).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
