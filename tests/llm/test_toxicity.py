"""The factorization machine: its score and its sample."""

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import toxicity


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(6)
    weights, factors = rng.normal(size=50), rng.normal(size=(50, toxicity.FACTORS))
    rows = [np.sort(rng.choice(50, k, replace=False)) for k in (0, 1, 2, 9, 30)]
    got, _ = toxicity.margins(np.concatenate(rows).astype(np.int64), np.cumsum([0, *map(len, rows)]), 0.3, weights, factors)
    want = [0.3 + sum(weights[i] for i in r) + sum(float(factors[i] @ factors[j]) for a, i in enumerate(r) for j in r[a + 1 :]) for r in rows]
    assert np.allclose(got, want)


def test_jobs_of_a_fit_do_not_grow_with_partitions(spark):
    """And a clashing column, null ids and labels that differ are no trouble."""
    rows = [(k if k % 9 else None, f"word{k % 7} other{k % 3}", "x") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5, 0)], "doc_id long, toxic int")
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for parts in (4, 60):
        spark.sparkContext.setJobGroup(f"fit{parts}", "fit")
        docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(parts)
        toxicity.fit(docs, labels, F.lit(True))
        jobs.append(len(tracker.getJobIdsForGroup(f"fit{parts}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 4 and max(jobs) < 40
