"""Exact nearest vectors without reading them all: bounds by pivots, bounds by 8-bit codes, and many queries at once.

All work on directions, so that a distance and a cosine tell the same:
``|q - u|^2 = 2 - 2 cos``.

* Vectors lie in folders by their nearest pivot.  Of each folder the least and
  the greatest distance to its pivot are known, and by the triangle inequality
  no vector of it is nearer to a query than these allow.
* A direction u is kept as bytes c and a step s, with e >= |u - s c|.  By
  Cauchy and Schwarz its cosine with q lies within e of that of s c.

A query first reads the codes of the folders whose pivots are nearest, until
these hold k vectors; the k-th best lower bound found there rules out folders.
The codes of the others give a lower bound for the k-th best cosine of all, and
only vectors whose upper bound reaches it are compared in full.  So the result
is that of a scan, ties by id included.

Vectors that are null, empty or zero, hold null or non-finite components, or
have another length than the first pivot, have no direction and are not found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most folders of an index, vectors that a folder should hold, and vectors that pivots are refined on, for each.
PARTS, MEMBERS, SAMPLE = 1024, 4096, 32
#: Queries that are compared with all vectors in one pass.
BLOCK = 1024
#: Most cosines of a block that a task holds at a time (8 bytes each).
TILE = 1 << 19
#: Places to which scores count as equal; beyond them products of blocks differ from one another.
PLACES = 12
_SLACK = 1e-9


def matrix(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places of the rows) of an Arrow column of lists that have a direction; of all, those of ``width``."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = width or (int(lengths[lengths > 0][0]) if (lengths > 0).any() else 0)
    at = np.flatnonzero(lengths == width) if width else np.empty(0, np.int64)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    rows = np.asarray(flat.fill_null(np.nan)).reshape(len(at), max(1, width)) if len(at) else np.empty((0, max(1, width)))
    fine = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return rows[fine], at[fine]


def directions(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, steps, errors) of directions."""
    step = np.abs(u).max(1) / 127
    codes = np.round(u / step[:, None]).astype(np.int8)
    return codes, step, np.linalg.norm(u - codes * step[:, None], axis=1) + _SLACK


def pivots_of(points: DataFrame, parts: int, vector: str = "vector", tie: str = "id", rounds: int = 5) -> np.ndarray:
    """``parts`` directions, means of a sample of ``SAMPLE`` vectors each: those whose id has the least hash."""
    found = points.orderBy(F.xxhash64(tie)).select(vector).limit(SAMPLE * parts).toArrow()[vector].combine_chunks()
    rows = directions(matrix(found)[0])
    if not len(rows):
        return rows
    out = rows[:: max(1, len(rows) // parts)][:parts].copy()
    for _ in range(rounds):
        near = (rows @ out.T).argmax(1)
        for j in range(len(out)):
            if (near == j).any() and (mean := rows[near == j].mean(0)).any():
                out[j] = mean / np.linalg.norm(mean)
    return out


def coded(points: DataFrame, pivots: np.ndarray, vector: str = "vector") -> DataFrame:
    """``points`` with part, far (the distance to its pivot), code, step and error."""
    held = points.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            rows, at = matrix(b.column(vector), held.value.shape[1])
            if not len(at):
                continue
            u = directions(rows)
            part = (u @ held.value.T).argmax(1)
            codes, step, error = quantise(u)
            far = np.linalg.norm(u - held.value[part], axis=1)
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(part.astype(np.int32)), pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), pa.array(error)], [*kept.schema.names, "part", "far", "code", "step", "error"])

    schema = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    return points.mapInArrow(run, f"{schema}, part int, far double, code binary, step double, error double")


def bounds(codes: DataFrame, query: np.ndarray, k: int, floor: float | None = None) -> DataFrame:
    """(id, part, low, high) of vectors that may be among the k nearest: a task drops what its own k-th lower bound, or ``floor``, rules out."""
    spark, tie = codes.sparkSession, codes.schema["id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(query)

    def run(batches):
        least = -np.inf if floor is None else floor
        best = np.empty(0)
        for b in batches:
            if not b.num_rows:
                continue
            c = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1)
            near = (c.astype(np.float64) @ held.value) * b.column("step").to_numpy()
            error = b.column("error").to_numpy()
            low, high = near - error, near + error
            if floor is None:
                best = np.sort(np.concatenate([best, low]))[-k:]
                least = best[0] if len(best) == k else -np.inf
            keep = np.flatnonzero(high >= least)
            rows = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("part"), pa.array(low[keep]), pa.array(high[keep])], ["id", "part", "low", "high"])

    return codes.select("id", "part", "code", "step", "error").mapInArrow(run, f"id {tie}, part int, low double, high double")


def kth_bound(found: DataFrame, k: int) -> float:
    """A cosine that at least k vectors reach, or -2 where there are fewer."""
    r = found.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("low"), F.count("*").alias("n")).first()
    return r.low if r.n == k else -2.0


def scored(points: DataFrame, query: np.ndarray, vector: str = "vector") -> DataFrame:
    """``points`` with their cosine; those without a direction go."""
    held = points.sparkSession.sparkContext.broadcast(query)

    def run(batches):
        for b in batches:
            rows, at = matrix(b.column(vector), len(held.value))
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array((directions(rows) @ held.value).round(PLACES))], [*kept.schema.names, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    return points.mapInArrow(run, f"{schema}, score double")


class VectorIndex:
    """Folders of codes and vectors by nearest pivot.

    ``codes`` has ``id``, the filters' columns and what is needed for bounds;
    ``vectors`` has all columns of the points.  ``folder`` is written once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.parts = spark.read.parquet(f"{self.folder}/parts").orderBy("part").collect()  # at most ``PARTS`` rows
        self.pivots = np.array([p.pivot for p in self.parts], np.float64)
        self.read = {"rows": 0, "codes": 0, "vectors": 0}

    @classmethod
    def build(cls, points: DataFrame, folder: str, parts: int | None = None, filters: tuple[str, ...] = ()) -> VectorIndex:
        """``points``: id, vector and more; its folders hold about ``MEMBERS`` vectors."""
        spark = points.sparkSession
        parts = parts or min(PARTS, max(1, math.ceil(points.count() / MEMBERS)))
        pivots = pivots_of(points, parts)
        rows = coded(points, pivots) if len(pivots) else points.where("false").select("*", F.lit(0).alias("part"), *(F.lit(0.0).alias(c) for c in ("far", "step", "error")), F.lit(b"").alias("code"))
        points.where("false").write.parquet(f"{folder}/shape")
        dealt = rows.hint("rebalance", "part")  # a folder is a file or, if it is large, some
        dealt.write.partitionBy("part").parquet(f"{folder}/rows")
        written = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
        # codes apart from the vectors, so that a scan of codes reads nothing else
        written.select("part", "id", "code", "step", "error", *filters).hint("rebalance", "part").sortWithinPartitions("id").write.partitionBy("part").parquet(f"{folder}/codes")
        spread = {r.part: r for r in written.groupBy("part").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect()}
        table = [(i, [float(x) for x in p], *((spread[i].low, spread[i].high, spread[i].n) if i in spread else (0.0, 0.0, 0))) for i, p in enumerate(pivots)]
        spark.createDataFrame(table, "part int, pivot array<double>, low double, high double, n long").write.parquet(f"{folder}/parts")
        return cls(spark, folder)

    def _codes(self, parts: list[int], where) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/codes").where(F.col("part").isin(parts))
        return rows if where is None else rows.where(where)

    def top_k(self, query: list[float], k: int, where=None) -> DataFrame:
        """The rows of the k nearest with ``score``, best first and ties by id; ``where`` is a condition on the filters' columns."""
        q = np.asarray(query, np.float64)
        empty = self.spark.read.parquet(f"{self.folder}/shape").withColumn("score", F.lit(0.0))
        if k < 1 or not len(self.pivots) or len(q) != self.pivots.shape[1] or not np.isfinite(q).all() or not q.any():
            return empty
        q = q / np.linalg.norm(q)
        away = np.linalg.norm(self.pivots - q, axis=1)
        low, high, n = (np.array([p[c] for p in self.parts]) for c in ("low", "high", "n"))
        least = np.maximum(0, np.maximum(away - high, low - away)) - _SLACK
        held = np.flatnonzero(n > 0)
        order = held[np.argsort(away[held], kind="stable")]
        first = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
        floor = kth_bound(bounds(self._codes(first.tolist(), where), q, k), k)
        reach = math.sqrt(max(0.0, 2 - 2 * floor)) + _SLACK
        visited = held[least[held] <= reach]
        codes = self._codes(visited.tolist(), where)
        if len(visited) > len(first):
            floor = kth_bound(bounds(codes, q, k), k)
        near = bounds(codes, q, k, floor)
        hit = [r.part for r in near.select("part").distinct().collect()]
        self.read = {"rows": int(n.sum()), "codes": int(n[visited].sum()), "vectors": int(n[hit].sum()) if hit else 0}
        if not hit:
            return empty
        rows = self.spark.read.parquet(f"{self.folder}/rows").where(F.col("part").isin(hit)).drop("far", "code", "step", "error")
        return scored(rows.join(near.select("id", "part").distinct(), ["id", "part"]), q).drop("part").orderBy(F.desc("score"), "id").limit(k)


# -- many queries --------------------------------------------------------------


class _Best:
    """The k best of each query so far: by score, to ``PLACES``, then by id.  New ones are merged when they are as many as those kept."""

    def __init__(self, queries: int, k: int):
        self.k, self.kth = k, np.full(queries, -np.inf)
        self.q, self.cosine, self.ids = np.empty(0, np.int64), np.empty(0), None
        self.new, self.waiting = [], 0

    def add(self, cosines: np.ndarray, ids: np.ndarray) -> None:
        """``cosines`` (queries, members) of the members ``ids``."""
        least = self.kth
        if cosines.shape[1] > self.k and np.isinf(least).any():
            least = np.maximum(least, np.partition(cosines, -self.k, axis=1)[:, -self.k])
        q, m = np.nonzero(cosines >= (least - 2 * 10.0**-PLACES)[:, None])
        self.new.append((q, cosines[q, m], ids[m]))
        self.waiting += len(q)
        if self.waiting > len(self.q):
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        held = [] if self.ids is None else [(self.q, self.cosine, self.ids)]
        q, s, i = (np.concatenate(x) for x in zip(*held, *self.new, strict=True))
        score = s.round(PLACES)
        order = np.lexsort((i, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        self.q, self.cosine, self.ids = q[place < self.k], s[keep], i[keep]
        last = order[place == self.k - 1]
        self.kth[q[place == self.k - 1]] = score[last]
        self.new, self.waiting = [], 0


def batch_top_k(queries: DataFrame, points: DataFrame, k: int, block: int = BLOCK, vector: str = "vector") -> DataFrame:
    """(query_id, id, score, cosine): for each of ``queries`` (query_id, vector) the k nearest ``points`` (id, vector), ties by id.

    Queries go out in blocks of about ``block``, each of which is compared with
    all vectors by matrix products of ``TILE`` cosines at the most; a task keeps
    k rows a query, and an aggregation merges the tasks.  Rows are in order by
    score, the cosine to ``PLACES``.
    """
    spark = queries.sparkSession
    query_type, id_type = queries.schema["query_id"].dataType.simpleString(), points.schema["id"].dataType.simpleString()
    blocks = max(1, math.ceil(queries.count() / block))
    schema = f"query_id {query_type}, id {id_type}, score double, cosine double"
    out = spark.createDataFrame([], schema)
    for n in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).select("query_id", F.col(vector).alias("vector")).toArrow().combine_chunks()  # about ``block`` rows
        names, column = some["query_id"].combine_chunks(), some["vector"].combine_chunks()
        for width in sorted({int(x) for x in column.value_lengths().to_pylist() if x}):
            rows, at = matrix(column, width)
            if len(rows):
                held = spark.sparkContext.broadcast((names.take(pa.array(at)), directions(rows)))
                found = points.select("id", F.col(vector).alias("vector")).mapInArrow(lambda b, held=held: _block_best(b, held, k), schema)
                out = out.unionByName(found)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "cosine"))), 1, k)  # k rows a task and query
    return out.groupBy("query_id").agg(best.alias("b")).select("query_id", F.explode("b").alias("b")).select("query_id", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"), F.col("b.cosine").alias("cosine"))


def _block_best(batches, held, k: int):
    names, q = held.value
    best, kind = _Best(len(q), k), None
    step = max(1, TILE // max(len(q), q.shape[1]))
    for b in batches:
        kind = b.column("id").type
        for first in range(0, b.num_rows, step):
            some = b.slice(first, step)
            rows, at = matrix(some.column("vector"), q.shape[1])
            if len(rows):
                ids = np.asarray(some.column("id").take(pa.array(at)).to_pylist(), dtype=None if pa.types.is_integer(kind) else object)
                best.add(q @ directions(rows).T, ids)
    best.merge()
    if best.ids is not None:
        yield pa.RecordBatch.from_arrays([names.take(pa.array(best.q)), pa.array(best.ids.tolist(), kind), pa.array(best.cosine.round(PLACES)), pa.array(best.cosine)], ["query_id", "id", "score", "cosine"])
