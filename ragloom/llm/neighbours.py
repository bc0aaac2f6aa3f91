"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook
of its own, fitted by k-means on a bounded sample, and pairs of codes are the
cells of a product grid.  A vector lies in one cell.  As a query it visits cells
in the order of a lower bound of the distance from it to them (how far the
boundaries to a cell's two centroids are), by the multi-sequence walk over both
halves, until a radius.  The radius is the least of ``RADII`` (parts of the
distance at the cosine limit) that reaches the wanted recall for copies of
sample vectors moved to the limit, in random directions and along single axes.
The last radius is the whole distance at the limit, and as the bound is a lower
bound, nothing within the limit lies beyond it: where no other radius will do,
the search is exact.  What a visit finds is verified by exact cosines.

Vectors are compared within a label and a vector length.  Each length has an
index of its own.  Its grid grows with the largest label, so that its cells hold
about ``CELL`` members, and the sample with the grid: ``CENTROIDS`` to ``MOST``
codes a half, fitted on ``SAMPLE`` or 16 vectors a code.

Equal vectors of a label are one class with a count, so copies are not
expanded.  A cell above ``BLOCK`` members is cut into blocks, each a task of
its own through which the queries stream.  Each task gives sums of links and a
spanning forest of them; no list of links leaves it.

Defined results: a vector that is null, empty or zero, holds null or
non-finite components, or has no label has no links; it stands alone.  Repeated
rows link with each other; a null vec_id never names a component unless all its
ids are null; an empty table gives an empty result; clashing input columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .simhash import Forest

COSINE, RECALL, SAMPLE, BLOCK, CELL = 0.98, 0.995, 4096, 4096, 256
CENTROIDS, MOST = 2, 2048
RADII = (0.25, 0.375, 0.5, 0.625, 0.75)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]


def k_means(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((x[:, None, :] - at[None]) ** 2).sum(2).argmin(1) if len(x) * len(at) * x.shape[1] < 1e8 else (x @ (-2 * at.T) + (at**2).sum(1)).argmin(1)
        for j in range(len(at)):
            if (near == j).any():
                at[j] = x[near == j].mean(0)
    return at


class MultiIndex:
    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS, cosine: float = COSINE, recall: float = RECALL):
        sample = unit(sample)
        self.half = sample.shape[1] // 2
        self.books = [k_means(sample[:, : self.half], centroids), k_means(sample[:, self.half :], centroids)]
        self.apart = [np.maximum(np.linalg.norm(b[:, None] - b[None], axis=2), 1e-12) for b in self.books]
        self.radius = self._radius(sample[:512], cosine, recall)

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Per half the distance to the boundary of each code, and the cell of each vector."""
        out, home = [], []
        for k, book in enumerate(self.books):
            part = x[:, : self.half] if k == 0 else x[:, self.half :]
            d = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            best = d.argmin(1)
            out.append(np.maximum(0, (d - d[np.arange(len(d)), best][:, None]) / (2 * self.apart[k][best])))
            out[-1][np.arange(len(d)), best] = 0
            home.append(best)
        return out, home[0] * len(self.books[1]) + home[1]

    def walk(self, a: np.ndarray, b: np.ndarray, radius: float) -> list[int]:
        """Cells by growing bound, from the two sorted sequences of codes, until ``radius``."""
        i_order, j_order, width = np.argsort(a, kind="stable"), np.argsort(b, kind="stable"), len(b)
        heap, seen, out = [(0.0, 0, 0)], {(0, 0)}, []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > radius * radius:
                break
            out.append(int(i_order[i]) * width + int(j_order[j]))
            for n in ((i + 1, j), (i, j + 1)):
                if n[0] < len(a) and n[1] < len(b) and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (float(a[i_order[n[0]]] ** 2 + b[j_order[n[1]]] ** 2), *n))
        return out

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        (a, b), home = self.bounds(x)
        return home, [self.walk(p, q, self.radius) for p, q in zip(a, b, strict=True)]

    def _radius(self, x: np.ndarray, cosine: float, recall: float) -> float:
        limit = math.sqrt(max(0.0, 2 - 2 * cosine))
        whole = limit + 1e-6  # for rounding
        if not len(x) or recall >= 1:
            return whole
        rng = np.random.default_rng(11)
        moved = []
        for kind in range(2):
            d = rng.standard_normal(x.shape) if kind == 0 else np.eye(x.shape[1])[rng.integers(0, x.shape[1], len(x))]
            d = unit(d - (d * x).sum(1)[:, None] * x)
            moved.append(cosine * x + np.sqrt(1 - cosine**2) * d)
        y = np.concatenate(moved)
        (a, b), home = self.bounds(np.concatenate([x, x]))
        (ay, by), home_y = self.bounds(y)
        width, at = len(self.books[1]), np.arange(len(y))
        there = np.sqrt(a[at, home_y // width] ** 2 + b[at, home_y % width] ** 2)
        back = np.sqrt(ay[at, home // width] ** 2 + by[at, home % width] ** 2)
        for r in RADII:
            if (np.minimum(there, back) <= r * limit).mean() >= recall:
                return r * limit
        return whole


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as rows of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def fit_indexes(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL, cell: int = CELL) -> dict[int, MultiIndex]:
    """An index for each vector length that has two members or more in a label."""
    sizes = classes.groupBy("d", "label").count().groupBy("d").agg(F.max("count").alias("largest"), F.sum("count").alias("all")).where("largest > 1")
    out = {}
    for r in sizes.collect():  # one row a vector length
        codes = min(MOST, max(CENTROIDS, math.ceil(math.sqrt(r.largest / cell))))
        wanted = max(SAMPLE, 16 * codes)
        share = F.lit(True) if r["all"] <= wanted else F.xxhash64("cid", "first") < F.lit(-(1 << 63) + int((1 << 64) * (wanted / r["all"])))
        sample = classes.where((F.col("d") == r.d) & share).select("cid", "v").toArrow().sort_by("cid")  # about ``wanted`` rows
        out[r.d] = MultiIndex(_matrix(sample["v"].combine_chunks()), codes, cosine, recall)
    return out


def near_groups(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    fine = F.coalesce(F.expr("label is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"), F.lit(False))
    single = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usable = rows.where(fine)
    grouped = usable.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = common.durable(grouped.select("label", F.size("v").alias("d"), "v", "first", "copies", F.monotonically_increasing_id().alias("cid")), "classes")
    held = spark.sparkContext.broadcast(fit_indexes(classes, cosine, recall, cell))
    common.small_batches(spark)

    def dealt(batches):
        """A row for each cell that a class visits; the row of its own cell has all of them."""
        for b in batches:
            lengths = b.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                part = b.take(pa.array(np.flatnonzero(lengths == d)))
                index = held.value.get(d)
                home, cells = index.cells(unit(_matrix(part.column("v")))) if index else (np.zeros(part.num_rows, np.int64), [[0]] * part.num_rows)
                n = np.array([len(c) for c in cells])
                out = part.take(pa.array(np.repeat(np.arange(part.num_rows), n)))
                cell, own = np.concatenate(cells), np.repeat(home, n)
                visits = [sorted(cells[i]) if at else None for i, at in zip(np.repeat(np.arange(len(cells)), n).tolist(), (cell == own).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int32()), pa.array(own, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], [*out.schema.names, "cell", "home", "visits"])

    visits = common.durable(classes.select("label", "d", "cid", "copies", "v").mapInArrow(dealt, "label string, d int, cid long, copies long, v array<double>, cell int, home int, visits array<int>"), "visits")
    sizes = visits.where("cell = home").groupBy("label", "d", "cell").count().select("label", "d", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # a member belongs to one block of its cell; it queries the blocks behind that, and visitors query all
    own = F.when(F.col("cell") == F.col("home"), F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).otherwise(-1)
    tasks = visits.join(sizes, ["label", "d", "cell"]).withColumn("own", own).withColumn("block", F.explode(F.sequence(F.greatest("own", F.lit(0)), F.col("blocks") - 1)))
    tasks = tasks.withColumn("asks", (F.col("own") != F.col("block")).cast("int")).select("label", "d", "cell", "block", "asks", "cid", "copies", "v", "home", "visits")
    keys = ["label", "d", "cell", "block"]
    found = common.durable(tasks.repartition(*keys).sortWithinPartitions(*keys, "asks", "cid").mapInArrow(partial(_solve, cosine=cosine), "link boolean, a long, b long"), "near")
    more = found.where(~F.col("link")).groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("more"))
    roots = common.durable(connected_components(found.where("link").select("a", "b")), "near")
    rooted = classes.join(roots, classes.cid == roots.node, "left").select("label", "v", "cid", "first", "copies", F.coalesce("root", "cid").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(named, "root").join(more, "cid", "left").select("label", "v", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    linked = usable.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(single)


class _Block:
    """The members of one block of a cell, and what is linked among them."""

    def __init__(self, cell: int, parts: list[tuple], cosine: float):
        self.cell, self.cosine = cell, cosine
        self.x, self.ids, self.copies = (np.concatenate([p[i] for p in parts]) for i in range(3))
        visits = [v for p in parts for v in p[4]]
        self.label = np.arange(len(self.ids))
        # which cells each member visits, as sorted (member, cell) in one number
        self.visits = np.concatenate([(at << 32) + np.asarray(v, np.int64) for at, v in enumerate(visits)])

    def _sums(self, ids: np.ndarray, more: np.ndarray):
        who, at = np.unique(ids, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(who), bool)), pa.array(who), pa.array(np.bincount(at, more).astype(np.int64))], ["link", "a", "b"])

    def _links(self, links: np.ndarray):
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(links), bool)), pa.array(links[:, 0]), pa.array(links[:, 1])], ["link", "a", "b"])

    def inner(self, rows: int = 2048):
        """Links of the members with each other, by rows of the triangle."""
        for first in range(0, len(self.ids), rows):
            q, k = np.nonzero(self.x[first : first + rows] @ self.x.T >= self.cosine)
            q, k = (q + first)[q + first < k], k[q + first < k]
            if len(q):
                yield from self._sums(self.ids[np.concatenate([q, k])], np.concatenate([self.copies[k], self.copies[q]]))
                forest = Forest(len(self.ids))
                forest.label = self.label
                forest.add(q, k)
                self.label = forest.label
                yield from self._links(self.ids[forest.links])

    def asked(self, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, home: np.ndarray):
        """Links between the members and visitors."""
        q, k = np.nonzero(x @ self.x.T >= self.cosine)
        # where the member visits the visitor's cell too, the pair is counted in the lesser cell only
        pair = (k.astype(np.int64) << 32) + home[q]
        at = np.minimum(np.searchsorted(self.visits, pair), len(self.visits) - 1)
        keep = (home[q] >= self.cell) | (self.visits[at] != pair)
        q, k = q[keep], k[keep]
        if len(q):
            yield from self._sums(np.concatenate([ids[q], self.ids[k]]), np.concatenate([self.copies[k], copies[q]]))
            forest = Forest(len(self.ids) + len(ids))
            forest.label[: len(self.ids)] = self.label
            forest.add(q + len(self.ids), k)
            self.label = forest.label[: len(self.ids)]
            yield from self._links(np.concatenate([self.ids, ids])[forest.links])


def _solve(batches, cosine: float):
    """Per task, sums of links (false, cid, n) and spanning links (true, cid, cid); members come before visitors."""
    task, block, gathered = None, None, []
    for b in batches:
        if not b.num_rows:
            continue
        key = list(zip(*(b.column(c).to_pylist() for c in ("label", "d", "cell", "block", "asks")), strict=True))
        cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            rows = b.slice(s, e - s)
            part = (unit(_matrix(rows.column("v"))), *(rows.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "copies", "home")))
            if gathered and (key[s][:4] != task or key[s][4]):
                block, gathered = _Block(task[2], gathered, cosine), []
                yield from block.inner()
            if key[s][:4] != task:
                task, block = key[s][:4], None
            if not key[s][4]:
                gathered.append((*part, rows.column("visits").to_pylist()))
            elif block is not None:
                yield from block.asked(*part)
    if gathered:
        yield from _Block(task[2], gathered, cosine).inner()
