"""SimHash near-duplicates, linked with BK-trees.

A text's fingerprint is the bitwise majority over XXH64 hashes of its 3-word
shingles.  Documents with one fingerprint are one vertex.  Two fingerprints at
distance 3 or less agree in at least two of five blocks of 12 or 13 bits, so
each fingerprint goes to ten shards, named by two blocks and the leading bits
of these: as many bits as leave about ``MEMBERS`` fingerprints to a shard, so
that shards keep their size while their number grows with the corpus.  A shard
is a BK-tree: children are keyed by the Hamming distance to their parent, and a
query of radius r follows only the edges d - r .. d + r.  The trees of many
shards are one set of arrays, and all queries go down together.

Trees are built and asked where the shard lies.  The members of shards above
``SHARD`` are dealt over rounds; each round broadcasts the trees of at most
about ``ROUND`` members and every fingerprint of those shards asks the tree of
its own shard.  So a broadcast is bounded, a hot shard is split over all tasks,
and fingerprints of other shards never reach the driver.

Of the links found only a spanning forest leaves a task; components are joined
across shards by ``connected_components``.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts under three words hash as one shingle; repeated rows each get
their row; a null doc_id never names a component unless all its ids are null;
an empty table gives an empty result; clashing input columns are not read.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

WIDTH, SEED, RADIUS = 3, 42, 3
#: (first bit, bits) of the blocks, and how many of them name a shard; blocks - kept >= RADIUS.
BLOCKS, KEPT = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)), 2
#: Members of a shard that one task holds, and members whose trees a round broadcasts (8 bytes each).
SHARD, ROUND = 20_000, 2_000_000
#: Members that a shard has in the mean, and pairs of a query and a node that go down at a time.
MEMBERS, FRONT = 32, 1 << 20


def shingle_hashes(text: str | None) -> bytes:
    """XXH64 of each shingle, big-endian, one after the other."""
    joined = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only; split: ASCII white space
    if not joined:
        return b""
    if len(joined) < WIDTH:
        return xxhash.xxh64_digest(b" ".join(joined), SEED)
    ends = np.cumsum([len(w) + 1 for w in joined]) - 1
    begins = (ends - [len(w) for w in joined]).tolist()
    whole, digest = b" ".join(joined), xxhash.xxh64_digest
    return b"".join([digest(whole[s:e], SEED) for s, e in zip(begins, ends[WIDTH - 1 :].tolist(), strict=False)])


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """uint64 per text."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        hashes = np.frombuffer(shingle_hashes(t), np.uint8).reshape(-1, 8)
        if len(hashes):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 1 << 16):
                ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
    return out


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", rid: str | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long; with ``rid``, the name of a long column, that one too."""
    common.small_batches(docs.sparkSession)
    kept = ["doc_id", "rid"] if rid else ["doc_id"]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(rid).alias("rid")] if rid else []))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(fingerprints(b.column("text").to_pylist()).view(np.int64))], [*kept, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "fp"]))


class BkTrees:
    """A BK-tree for each run of equal ``keys`` over its distinct 64-bit ``values``, built level by level; nodes are known by their place.

    ``asked`` and ``followed`` count the nodes that queries met and the edges
    they went down.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.values = values
        self.keys, begins = np.unique(keys, return_index=True)
        if len(keys) and (keys[1:] < keys[:-1]).any():
            raise ValueError("keys must be sorted")
        self.roots = begins
        links = []  # parent * 65 + edge, child
        group = np.repeat(np.arange(len(begins)), np.diff([*begins, len(keys)]))
        rest, heads = np.arange(len(keys)), begins
        while len(rest):
            first = np.concatenate([[True], group[1:] != group[:-1]])
            parent = rest[first][group]
            rest, parent = rest[~first], parent[~first]
            edge = parent * 65 + np.bitwise_count(values[rest] ^ values[parent]).astype(np.int64)
            order = np.argsort(edge, kind="stable")
            rest, edge = rest[order], edge[order]
            heads, at, group = np.unique(edge, return_index=True, return_inverse=True)
            links.append((heads, rest[at]))
        self.edges, self.children = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], self.children[order]
        self.asked = self.followed = 0

    def root_of(self, keys: np.ndarray) -> np.ndarray:
        """Places of the roots for keys that all have a tree."""
        return self.roots[np.searchsorted(self.keys, keys)]

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Yields (query places, node places) of all pairs within ``radius``, each query in the tree of its root."""
        todo = [(np.arange(len(queries)), roots)]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONT:  # so that a front stays small, whatever the trees
                todo += [(q[FRONT:], node[FRONT:])]
                q, node = q[:FRONT], node[:FRONT]
            if not len(q):
                continue
            far = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = far <= radius
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(far - radius, 0))
            n = np.searchsorted(self.edges, node * 65 + np.minimum(far + radius, 64), "right") - low
            self.asked += len(q)
            self.followed += int(n.sum())
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(low, n)
            todo.append((np.repeat(q, n), self.children[at]))


class Forest:
    """Union-find with flat labels: a part is named by its least place."""

    def __init__(self, size: int):
        self.label = np.arange(size)
        self.joined: list[np.ndarray] = [np.empty((0, 2), np.int64)]

    @property
    def links(self) -> np.ndarray:
        """Pairs of places that connect what was added."""
        return np.concatenate(self.joined)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        new = x != y
        if not new.any():
            return
        names, at = np.unique(np.concatenate([x[new], y[new]]), return_inverse=True)
        p, q = at.reshape(2, -1)
        root = np.arange(len(names))
        while True:  # the least name spreads along the pairs
            old = root
            low = np.minimum(root[p], root[q])
            root = root.copy()
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
            root = root[root]
            if (root == old).all():
                break
        moved = np.flatnonzero(root != np.arange(len(names)))
        self.joined.append(np.stack([names[moved], names[root[moved]]], axis=1))
        place = np.minimum(np.searchsorted(names, self.label), len(names) - 1)
        self.label = np.where(names[place] == self.label, names[root[place]], self.label)


def tree_links(trees: BkTrees, keys: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Spanning links (n, 2) between the trees' values and ``queries``, each of which asks the tree of its key."""
    names, at = np.unique(np.concatenate([trees.values, queries]), return_inverse=True)  # a fingerprint is one vertex in all shards
    member, asking = at[: len(trees.values)], at[len(trees.values) :]
    forest = Forest(len(names))
    for q, m in trees.near(queries, trees.root_of(keys), radius):
        forest.add(asking[q], member[m])
    return names[forest.links]


def _link_batch(found: list[np.ndarray]):
    links = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
    links = np.ascontiguousarray(links[links[:, 0] != links[:, 1]]).view(np.int64)
    if len(links):
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)


def _shard_links(batches, radius: int, size: int = 1 << 18):
    """Links inside shards, from rows sorted by key; shards are held whole, about ``size`` members at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def solve(keys, fps):
        yield from _link_batch([tree_links(BkTrees(keys, fps), keys, fps, radius)] if len(keys) else [])

    for b in batches:
        held.append(_columns(b))
        rows += b.num_rows
        if rows >= size:
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on in the next batch
            yield from solve(keys[:whole], fps[:whole])
            held, rows = [(keys[whole:], fps[whole:])], len(keys) - whole
    if held:
        yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _asked(batches, trees, radius: int):
    """Links between fingerprints of hot shards and the broadcast trees."""
    for b in batches:
        keys, fps = _columns(b)
        here = np.isin(keys, trees.value.keys)
        yield from _link_batch([tree_links(trees.value, keys[here], fps[here], radius)] if here.any() else [])


def shard_bits(count: int, members: int = MEMBERS) -> int:
    """Bits of a shard's name, so that of ``count`` fingerprints about ``members`` have one in common, as far as two blocks go."""
    return min(KEPT * min(width for _, width in BLOCKS), max(0, math.ceil(math.log2(max(1, count / members)))))


def shard_keys(bits: int) -> Column:
    """The names of a fingerprint's shards: which blocks, and their leading ``bits`` together."""
    keys = []
    for n, kept in enumerate(combinations(range(len(BLOCKS)), KEPT)):
        key = F.lit(n).cast("long")
        for place, k in enumerate(kept):
            width = (bits + KEPT - 1 - place) // KEPT
            first = BLOCKS[k][0] + BLOCKS[k][1] - width
            key = F.shiftleft(key, width).bitwiseOR(F.expr(f"shiftrightunsigned(fp, {first}) & {(1 << width) - 1}"))
        keys.append(key)
    return F.array(*keys)


def near_links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD, round_: int = ROUND, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) that connect whatever distinct ``fp`` lie within ``radius``; radius <= blocks - kept blocks."""
    spark = values.sparkSession
    sharded = values.select("fp", F.explode(shard_keys(shard_bits(values.count(), members))).alias("key")).select("key", "fp")
    hot = common.durable(sharded.groupBy("key").count().where(F.col("count") > shard), "simhash")
    common.small_batches(spark, 20_000)
    light = sharded if hot.isEmpty() else sharded.join(hot.select("key"), "key", "left_anti")
    links = light.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_shard_links, radius=radius), "a long, b long")
    total = hot.agg(F.sum("count")).first()[0] or 0
    if not total:
        return links
    asking = common.durable(sharded.join(hot.select("key"), "key", "left_semi"), "simhash")
    rounds = -(-total // round_)
    for n in range(rounds):
        held = asking.where(F.pmod(F.xxhash64("key", "fp"), F.lit(rounds)) == n).toArrow().sort_by("key")  # about ``round_`` rows at the most
        keys, fps = held["key"].to_numpy(), held["fp"].to_numpy().view(np.uint64)
        trees = spark.sparkContext.broadcast(BkTrees(keys, fps))
        links = links.unionByName(common.durable(asking.mapInArrow(partial(_asked, trees=trees, radius=radius), "a long, b long"), "simhash"))
        trees.unpersist()
    return links


def _rooted(values: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(fp, first, root) for ``values`` (fp, first) of distinct fingerprints."""
    values = common.durable(values, "simhash")
    roots = common.durable(connected_components(near_links(values, radius, shard)), "simhash")
    return values.join(roots, values.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (its least doc_id)."""
    rows = common.durable(with_fingerprint(docs, key, text), "simhash")
    rooted = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), radius, shard)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = common.durable(rooted.join(named, "root").select("fp", "component_id"), "simhash")
    return rows.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one row of each component: the one with the least ``key``, null keys last, and of equal keys any one row.

    A key that one row has alone stands for its row.  Rows whose key is null or
    repeated are written once with a row id, which stands for them.
    """
    name, again_name = common.fresh(docs, "kept_id"), common.fresh(docs, "again")
    number = docs[key].cast("long")
    counts = docs.select(number.alias(again_name)).where(F.col(again_name).isNotNull()).groupBy(again_name).count()
    again = common.durable(counts.where(F.col("count") > 1).select(again_name), "simhash")
    shared = docs.join(again, number == again[again_name], "left_semi").unionByName(docs.where(number.isNull()))
    shared = common.durable(shared.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")), "simhash")
    alone = docs.where(number.isNotNull()).join(again, number == again[again_name], "left_anti")
    numbered = shared.select(F.col("row")[key].alias("key"), F.col("row")[text].alias("text"), "rid")
    rows = with_fingerprint(alone, key, text).select("doc_id", F.lit(None).cast("long").alias("rid"), "fp").unionByName(with_fingerprint(numbered, "key", "text", "rid"))
    rows = common.durable(rows, "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("first")
    rooted = _rooted(rows.groupBy("fp").agg(first))
    stay = rooted.groupBy("root").agg(F.min("first").alias("stay"))
    known = rooted.select("fp", "root").join(stay, "root").select("fp", "stay")
    # the rows that go, by key or number alone and written: their size decides whether texts are shuffled to meet them
    gone = rows.join(known, "fp").where(~(F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & F.col("rid").eqNullSafe(F.col("stay.rid"))))
    gone = common.durable(gone.select(F.col("doc_id").alias(name), "rid"), "simhash")
    by_key, by_row = gone.where("rid is null").select(name), gone.where("rid is not null").select("rid")
    left = docs.where(number.isNotNull()).join(again, number == again[again_name], "left_anti").join(by_key, number == by_key[name], "left_anti")
    return left.unionByName(shared.join(by_row, "rid", "left_anti").select("row.*"))
