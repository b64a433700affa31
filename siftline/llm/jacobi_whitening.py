"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

``fit`` takes three passes over the vectors and sends d x d numbers to the driver, whatever
their count:
1. counts and sums of each dimension, combined before the shuffle;
2. a blockwise QR of the centred rows (TSQR): each task folds its batches into one triangle
   R, triangles are folded ``FAN`` at a time until one is left, so no task holds more than
   ``FAN`` of them;
3. plane rotations make the columns of R orthogonal (``one_sided_jacobi``). The accumulated
   rotations are the components, the columns' lengths the standard deviations times the
   square root of n. No covariance is formed for them, so small deviations keep their digits.

``Whitening.apply`` projects in one narrow pass, ``report`` is the query.

Defined results: vectors that are null, empty or hold null or non-finite entries, or entries
beyond 2**42, are not in the fit and give no rows, nor do vectors of another length than the
most frequent one (of equally frequent ones the longest). Null and repeated ids are rows like
any other. A component without variance (fewer distinct vectors than dimensions, constant
dimensions) has null whitened values and explains 0. An empty table gives no rows.
``deviation`` is exact, and null where it passes a long. Only the two named columns are
read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN = 8
SWEEPS = 40
LIMIT = 1 << 42


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: count, exact sums, components (columns, by falling deviation), deviations and the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.deviations**2 / self.trace if self.trace else np.zeros(len(self.deviations))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x * self.n - self.sums) / self.n if self.n * int(np.abs(x).max(initial=0)) < 1 << 62 else x - self.sums / self.n

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened coordinates of integer rows; NaN without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.deviations[:k] > 0, self.centred(x) @ self.components[:, :k] / self.deviations[:k], np.nan)


def one_sided_jacobi(r: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values), falling, of a square matrix.

    Each step of a sweep rotates d / 2 disjoint pairs of columns, in a round-robin order, until
    all pairs are orthogonal to machine precision.
    """
    d = r.shape[1]
    even = d + d % 2
    a = np.zeros((r.shape[0], even))
    a[:, :d] = r
    v = np.eye(even)
    order = np.arange(even)
    small = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            p, q = order[: even // 2], order[even // 2 :][::-1]
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(axis=0), (aq * aq).sum(axis=0), (ap * aq).sum(axis=0)
            bent = np.abs(gamma) > small * np.sqrt(alpha * beta)
            if bent.any():
                turned = True
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    zeta = (beta - alpha) / (2 * gamma)
                    t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                t = np.where(bent, t, 0.0)
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                for m in (a, v):
                    mp, mq = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
            order = np.r_[order[0], order[-1], order[1:-1]]
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(axis=0))[:d]
    v = v[:d, :d]
    by = np.argsort(-lengths, kind="stable")
    v = v[:, by]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return v, lengths[by]


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has entries, all of them finite."""
    fine = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LIMIT))
    return vectors.where((F.size(column) > 0) & fine)


def integers(batch: pa.Array, length: int | None = None) -> np.ndarray:
    """floor(1024 * c) + 100000 of each entry, as rows."""
    flat = np.asarray(batch.flatten(), np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(batch), length or -1)


def moments(vectors: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """How many vectors the fit has, and their exact sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            lengths = np.asarray(batch.column(0).value_lengths())
            for d in np.unique(lengths).tolist():
                x = integers(batch.column(0).filter(pa.array(lengths == d)), d)
                n, s = known.get(d, (0, np.zeros(d, np.int64)))
                known[d] = n + len(x), s + x.sum(axis=0)
        rows = [(d, k, n, v) for d, (n, s) in known.items() for k, v in enumerate(s.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["d", "k", "n", "s"])

    per = usable(vectors, column).select(column).mapInArrow(sums, "d long, k long, n long, s long").groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = per.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "s"))).alias("sums")).orderBy(F.desc("n"), F.desc("d")).first()
    return (best["n"], np.array([s["s"] for s in best["sums"]], np.int64)) if best else (0, np.zeros(0, np.int64))


def _triangle(stacked: np.ndarray, d: int) -> np.ndarray:
    r = np.linalg.qr(stacked, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def tsqr(vectors: DataFrame, column: str, centre: Whitening) -> np.ndarray:
    """The triangle R of all centred rows, from tasks over blocks and a tree of tasks over triangles."""
    d = len(centre.sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((d, d))
        for batch in batches:
            x = integers(batch.column(0), d)
            for at in range(0, len(x), 4 * d + 256):
                r = _triangle(np.vstack([r, centre.centred(x[at : at + 4 * d + 256])]), d)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], names=["block", "r"])

    def join(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(r, np.float64).reshape(d, d) for r in table.column("r").to_pylist()]
        return pa.table({"block": table.column("block").slice(0, 1), "r": [_triangle(np.vstack(parts), d).tobytes()]})

    rows = usable(vectors, column).where(F.size(column) == d).select(column)
    blocks, triangles = rows.rdd.getNumPartitions(), rows.mapInArrow(fold, "block long, r binary")
    while blocks > 1:
        triangles = triangles.withColumn("block", F.floor(F.col("block") / FAN)).groupBy("block").applyInArrow(join, "block long, r binary")
        blocks = -(-blocks // FAN)
    return np.frombuffer(triangles.first()["r"], np.float64).reshape(d, d)


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening:
    """The whitening of all usable vectors, taken as the integers floor(1024 * c) + 100000."""
    n, sums = moments(vectors, column)
    d = len(sums)
    if not n:
        return Whitening(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    centre = Whitening(n, sums, np.eye(d), np.ones(d), 1.0)
    components, lengths = one_sided_jacobi(tsqr(vectors, column, centre))
    lengths = np.where(lengths > lengths.max() * d * np.finfo(float).eps, lengths, 0.0)
    return Whitening(n, sums, components, lengths / np.sqrt(n), float((lengths**2).sum() / n))


def apply(vectors: DataFrame, model: Whitening, column: str = "embedding", k: int = COMPONENTS, name: str = "whitened") -> DataFrame:
    """vectors of the fit's length with their first k whitened coordinates in a new column."""
    if name.lower() in (c.lower() for c in vectors.columns):
        raise ValueError(f"the table has a column {name} already")
    d, k = len(model.sums), min(k, len(model.sums))

    def project(values: pa.Array) -> pa.Array:
        z = model.project(integers(values, d), k)
        offsets = pa.array(np.arange(0, k * len(z) + 1, k, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(z.ravel(), from_pandas=True))

    use = F.arrow_udf(project, "array<double>")
    rows = usable(vectors, column).where(F.size(column) == d)
    return rows.withColumn(name, use(column)) if model.n else rows.withColumn(name, F.lit(None).cast("array<double>"))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding", k: int = COMPONENTS) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    k = int((model.deviations[:k] > 0).sum())
    d = len(model.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = model.project(integers(batch.column(0), d), k)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["cell", "v"])

    if not k:
        return 0.0
    cells = usable(vectors, column).where(F.size(column) == d).select(column).mapInArrow(products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    covariance = np.zeros(k * k)
    for row in cells:
        covariance[row["cell"]] = row["v"] / model.n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sum of (n * x - S) ** 2 of each row; None beyond a long."""
    bound = (model.n * float(np.abs(x).max(initial=0)) + float(np.abs(model.sums).max(initial=0))) if len(x) else 0.0
    if bound < 1 << 62:
        y = x * model.n - model.sums
        if float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return (y * y).sum(axis=1).tolist()
    sums = model.sums.tolist()
    exact = (sum((model.n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [e if e < 1 << 63 else None for e in exact]


REPORT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component."""
    model = fit(vectors, column)
    d, k = len(model.sums), min(k, len(model.sums))
    error = identity_error(vectors, model, column, k)
    explained = model.explained[:k]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), d)
            many = np.repeat(np.arange(len(x)), k)
            arrays = [
                batch.column(0).take(pa.array(many)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(k * len(x), model.n, np.int64)),
                pa.array(deviations(x, model), pa.int64()).take(pa.array(many)),
                pa.array(model.project(x, k).ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(k * len(x), error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in REPORT.split(", ")])

    return usable(vectors, column).where(F.size(column) == d).select(F.col("vec_id").cast("long").alias("vec_id"), column).mapInArrow(rows, REPORT)
