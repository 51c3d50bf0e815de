"""Whitening of embeddings by TSQR: QR factors of row blocks merge in a tree, and the covariance is never formed.

Entries become whole numbers ``x = floor(64 c) + 1000000``. The fit list holds each distinct x vector once; its count and sums are exact integers,
so rows are centred without cancellation: the whole part of the mean is taken off as an integer first. Each task factors its
centred rows, block by block, into one triangle R; triangles merge ``FAN`` at a time until one is left. Its right singular vectors are the eigenvectors
of the covariance and its singular values, squared over n, the eigenvalues. A task holds one block and one triangle; the driver holds
the sums and the last triangle, whose sizes depend on the dimension only.

Defined results
* vectors that are null, empty, or hold a null or non-finite entry, or one of 2^47 or more (x is then beyond exact doubles): no rows.
* vectors of several lengths: the space is that of the commonest length of the fit list (of equally common ones the greatest); others give no rows.
* repeated vectors count once in the fit; each row gets its results. Null and equal ids: each row is on its own.
* components without variance (beyond the rank of the fit list) are left out; so one distinct vector, or an empty table, gives no rows.
* eigenvalues that tie: any unit basis of their space, the same for all rows. The greatest entry of a component is positive.
* a ``deviation`` beyond 64 bits is null. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import discard, materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Triangles that merge at once.
FAN = 8
#: Greatest size of an entry.
LARGEST = 2.0**47


class Whitening(NamedTuple):
    """A fit: count, whole and remaining part of the means (S = n * whole + rest), components as rows, their eigenvalues, and the trace."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        off = x - self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        kind = np.int64 if most * most * x.shape[1] < 2**63 else object
        return [d if d < 2**63 else None for d in ((self.n * off.astype(kind) - self.rest.astype(kind)) ** 2).sum(axis=1).tolist()]


def numbers(vector: Column) -> Column:
    """The whole numbers of a vector, null where it holds what has none."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST))
    return F.when(good & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a batch, a matrix for each length."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths := column.value_lengths().to_numpy(zero_copy_only=False))
    for d in np.unique(lengths):
        own = ends[lengths == d]
        yield flat[(own - d)[:, None] + np.arange(d)]


def moments(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Count and sums by dimension of the vectors of the commonest length; exact at any size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for x in _matrices(batch.column("x")):
                n, s = found.get(x.shape[1], (0, np.zeros(x.shape[1], dtype=object)))
                found[x.shape[1]] = n + len(x), s + sum(p.sum(axis=0).astype(object) for p in np.array_split(x, len(x) // 64 + 1))
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([[str(v) for v in s]])], names=["d", "n", "s"])

    parts = materialize(fit_list.mapInArrow(partial, "d long, n long, s array<string>"), "white-sums")
    space = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if space is None:
        discard(parts)
        return 0, []
    each = parts.filter(F.col("d") == space["d"]).select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = [int(r["v"]) for r in each.orderBy("at").collect()]
    discard(parts)
    return space["n"], sums


def triangle(fit_list: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred vectors: factors of tasks, merged in a tree."""
    d = len(sums)
    mean = Whitening(n, np.array([s // n for s in sums]), np.array([s % n for s in sums]), np.zeros((0, d)), np.zeros(0), 0.0)
    block = max(1024, 4 * d)

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for x in _matrices(batch.column("x")):
                if x.shape[1] == d:
                    for at in range(0, len(x), block):
                        r = np.linalg.qr(np.vstack([r, mean.centred(x[at : at + block])]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()])], names=["part", "r"])

    def merged(table: pa.Table) -> pa.Table:
        rs = table.sort_by("part")
        r = np.zeros((0, d))
        for own in rs.column("r").to_pylist():
            r = np.linalg.qr(np.vstack([r, np.frombuffer(own).reshape(-1, d)]), mode="r")
        return pa.table({"part": pa.array([rs.column("part")[0].as_py() // FAN], pa.int64()), "r": [r.tobytes()]})

    level = materialize(fit_list.mapInArrow(factored, "part long, r binary"), "white-r")
    while (count := level.count()) > 1:
        lower = level
        level = materialize(lower.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(merged, "part long, r binary"), "white-r")
        discard(lower)
    r = np.frombuffer(bytes(level.first()["r"])).reshape(-1, d) if count else np.zeros((0, d))
    discard(level)
    return r


def fit(vectors: DataFrame, most: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """A fit over the distinct vectors ``x`` and the written list of them."""
    fit_list = materialize(vectors.select("x").filter("x is not null").distinct(), "white-fit")
    n, sums = moments(fit_list)
    if n < 2:
        return None, fit_list
    _, s, vt = np.linalg.svd(triangle(fit_list, n, sums), full_matrices=False)
    rank = int((s > s[0] * max(n, len(sums)) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    k = min(rank, most)
    top = vt[:k] * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])[:, None]
    return (Whitening(n, np.array([v // n for v in sums]), np.array([v % n for v in sums]), top, s[:k] ** 2 / n, float((s**2).sum() / n)) if k else None), fit_list


def identity_error(model: Whitening, fit_list: DataFrame) -> float:
    """The greatest entry of the whitened fit list's covariance minus the identity, from all its rows."""
    k, d = model.vectors.shape

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for x in _matrices(batch.column("x")):
                if x.shape[1] == d:
                    w = model.whitened(x)
                    total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) * k)), pa.array(total.ravel())], names=["cell", "v"])

    cells = fit_list.mapInArrow(products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    total = np.array([c["v"] for c in cells]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): up to ``COMPONENTS`` rows for each row with a good vector."""
    found = rows.select(F.col(key), numbers(F.col(vector)).alias("x"))
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, fit_list = fit(found)
    if model is None:
        discard(fit_list)
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(model, fit_list)
    discard(fit_list)
    k, d = model.vectors.shape

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column = part.column("x")
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                m, each = len(x), np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return found.filter(F.size("x") == d).mapInArrow(projected, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
