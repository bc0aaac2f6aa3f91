"""Embedding whitening by a two-pass covariance.

Entries become longs, x = floor(256 * c), and each distinct x vector is fitted
once.  The first pass sums x exactly, so the mean is exact; the second sums
outer products of what is centred by it, one NumPy matrix product a batch, and
``treeAggregate`` merges the tasks' matrices.  LAPACK's symmetric solver gives
the components, whose projection is broadcast: it has as many numbers as the
vectors have entries, times ``components``, however many rows there are.

Vectors of one length share a fit; a table of several lengths has several.

Defined results: a vector that is null or empty, or holds a null or non-finite
entry or one whose 256-fold is no long, is dropped.  Repeated rows each get
their rows and count once in the fit; a null vec_id is kept.  Vectors with
fewer entries than ``components`` have fewer components.  A component whose
eigenvalue is zero up to rounding (one distinct vector, constant entries) has
``whitened`` null and does not enter ``identity_error``, which is null where no
component is left.  ``deviation`` is null where it is no long;
``deviation_exact`` then has it, as a decimal.  An empty table gives an empty
result; clashing input columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS, SCALE = 4, 256
#: Rows of a matrix product, so that a batch of long vectors stays small.
BLOCK = 4096


def _vectors(column) -> np.ndarray:
    """An Arrow column of equally long lists as rows of int64."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch):
    """(length, places, x) for each vector length of a batch, in blocks."""
    lengths = batch.column("x").value_lengths().to_numpy()
    for d in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == d)
        for first in range(0, len(places), BLOCK):
            at = places[first : first + BLOCK]
            yield d, at, _vectors(batch.column("x").take(pa.array(at)))


@dataclass
class Fit:
    """n fitted vectors, their sums by entry, and once known the projection, eigenvalues and shares of its components."""

    n: int
    sums: list[int]
    values: np.ndarray | None = None
    axes: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, the whole part taken off exactly."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        if max(map(abs, whole)) >= 1 << 61 or np.abs(x.astype(np.float64)).max() >= 2.0**61:  # a difference of longs may not be one
            return x.astype(np.float64) - np.array([s / self.n for s in self.sums])
        return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([r / self.n for r in rest])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over entries of (n * x - sums) ** 2, exact."""
        most = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]

    def solve(self, outer: np.ndarray, components: int) -> None:
        """Eigenvectors of outer / n by falling eigenvalue; the largest entry of each is positive."""
        values, vectors = np.linalg.eigh(outer / self.n)
        self.values = values[::-1][:components]
        axes = vectors.T[::-1][:components]
        self.axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
        total = float(np.trace(outer)) / self.n
        self.explained = self.values / total if total > 0 else np.zeros(len(self.values))
        self.floor = max(float(values[-1]), 0.0) * len(values) * np.finfo(float).eps

    @property
    def real(self) -> np.ndarray:
        """Which components have a variance."""
        return self.values > self.floor

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Per row its place on each component over the root of its eigenvalue; NaN without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.real, self.centred(x) @ self.axes.T / np.sqrt(np.where(self.real, self.values, 1.0)), np.nan)


def integers(embedding: str):
    """The vector as longs, null where it is dropped."""
    v = F.col(embedding).cast("array<double>")
    scaled = F.transform(v, lambda c: c * F.lit(float(SCALE)))
    fine = (F.size(v) > 0) & ~F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(2.0**63)))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(scaled, lambda c: F.floor(c).cast("long")))


def _sums(batches):
    """(d, entry, n, total) of a task's vectors."""
    held: dict[int, tuple[int, list[int]]] = {}
    for b in batches:
        for d, _, x in _by_length(b):
            n, sums = held.get(d, (0, [0] * d))
            most = max(abs(int(x.max())), abs(int(x.min())))
            part = x.sum(0).tolist() if most * len(x) < 1 << 62 else [sum(c) for c in zip(*x.tolist(), strict=True)]
            held[d] = n + len(x), [a + b for a, b in zip(sums, part, strict=True)]
    for d, (n, sums) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["d", "entry", "n", "total"])


def _outer(batches, fits):
    """(d, matrix) of a task: the sum of outer products of centred vectors."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for d, _, x in _by_length(b):
            c = fits.value[d].centred(x)
            held[d] = held.get(d, 0) + c.T @ c
    yield from _matrices(held)


def _whitened_outer(batches, fits):
    """(d, matrix) of a task: a row of sums, then the sum of outer products of whitened vectors, over components with a variance."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for d, _, x in _by_length(b):
            w = fits.value[d].whiten(x)[:, fits.value[d].real]
            held[d] = held.get(d, 0) + np.concatenate([w.sum(0)[None], w.T @ w])
    yield from _matrices(held)


def _matrices(held: dict[int, np.ndarray]):
    for d, m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.astype(np.float64).tobytes()], pa.binary())], ["d", "matrix"])


def _merged(tasks: DataFrame) -> dict[int, np.ndarray]:
    """The tasks' matrices by length, merged in a tree so that the driver meets only a few."""

    def put(held, row):
        m = np.frombuffer(row.matrix, np.float64)
        held[row.d] = held[row.d] + m if row.d in held else m
        return held

    def join(a, b):
        for d, m in b.items():
            a[d] = a[d] + m if d in a else m
        return a

    return tasks.rdd.treeAggregate({}, put, join, depth=2)


def whiten(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per kept row and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), integers(embedding).alias("x")).where("x is not null")
    fitted = common.durable(rows.select("x").distinct(), "whitening")

    found = fitted.mapInArrow(_sums, "d int, entry int, n long, total decimal(38,0)").groupBy("d", "entry").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    fits: dict[int, Fit] = {}
    for r in found.orderBy("d", "entry").collect():  # a row for each entry of a vector
        fits.setdefault(r.d, Fit(r.n, [])).sums.append(int(r.total))
    held = spark.sparkContext.broadcast(fits)
    for d, m in _merged(fitted.mapInArrow(lambda b: _outer(b, held), "d int, matrix binary")).items():
        fits[d].solve(m.reshape(d, d), components)
    held.unpersist()

    projection = spark.sparkContext.broadcast(fits)
    for d, m in _merged(fitted.mapInArrow(lambda b: _whitened_outer(b, projection), "d int, matrix binary")).items():
        fit = fits[d]
        if k := int(fit.real.sum()):
            sums = m[:k] / fit.n
            fit.identity_error = float(np.abs(m[k:].reshape(k, k) / fit.n - np.outer(sums, sums) - np.eye(k)).max())
    projection.unpersist()
    final = spark.sparkContext.broadcast(fits)

    def project(batches):
        for b in batches:
            for d, at, x in _by_length(b):
                fit = final.value[d]
                k = len(fit.values)
                far, white = fit.deviation(x), fit.whiten(x)
                one, n = np.repeat(np.arange(len(at)), k), len(at) * k
                columns = {
                    "vec_id": b.column("vec_id").take(pa.array(at)).take(pa.array(one)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    "n": pa.array(np.full(n, fit.n, np.int64)),
                    "deviation": pa.array([v if v < 1 << 63 else None for v in far], pa.int64()).take(pa.array(one)),
                    "whitened": pa.array(white.ravel(), from_pandas=True),
                    "explained": pa.array(np.tile(fit.explained, len(at))),
                    "identity_error": pa.array([fit.identity_error] * n, pa.float64()),
                    "deviation_exact": pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0)).take(pa.array(one)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
