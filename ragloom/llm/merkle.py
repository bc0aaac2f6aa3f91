"""Merkle manifest of a dataset, with a proof for every document.

Leaves of a source stand in the order of their doc_id.  Their ranks come from a
radix trie: sort keys are written as hex digits, documents are counted by a
prefix of their key that leaves at most ``BIN`` of them together, those counts
are summed two digits at a time up to the digits that all keys share, and on
the way down each prefix gets the number of documents before it.  So every
window holds at most 256 prefixes or ``BIN`` documents, and nothing is sorted
as a whole.  Sources are ranked among each other in the same way.

A node of the tree is known by its group and the leading digits, to the base of
the fanout, of the ranks below it; level by level the nodes with one such
prefix become their parent.  A run of children, at most ``FANOUT``, is one row;
going down again each run meets its parent by prefix, and so learns the
siblings on the way to the root without any join on the source, of which one
may hold a third of all rows.

Only DataFrame functions are used.

Defined results: a null doc_id comes before all others and is written as ``-``,
as are other nulls; rows with one doc_id are ordered by their leaf, and wholly
equal rows stand side by side, each with its own proof; a null source is a
source of its own; a row whose id is null is not tampered with; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FANOUT, BIN = 16, 1024
#: Equal rows that one row stands for while they are dealt out.
CHUNK = 4096
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its value, or ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def _id_key(doc_id: str) -> Column:
    """17 hex digits in the order of the ids, null first."""
    digits = F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.coalesce(F.concat(F.lit("1"), digits), F.lit("0" * 17))


def _source_key(source: Column) -> Column:
    """Hex digits in the order of the sources' bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.hex(F.encode(source.cast("string"), "UTF-8"))), F.lit("0"))


def _prefix(of: str | Column, digits: int) -> Column:
    return F.substring(of, 1, digits)


def _common(a: str | None, b: str | None) -> int:
    """Digits that both begin with, an odd number, as the first digit tells null and the others come in pairs."""
    same = next((i for i, (x, y) in enumerate(zip(a or "", b or "", strict=False)) if x != y), min(len(a or ""), len(b or "")))
    return same - 1 + same % 2 if same else 0


def radix_ranks(rows: DataFrame, bin_: int = BIN) -> DataFrame:
    """``rows`` (g, key, n, ...), keys different within a group, with ``rank``, the sum of n before a row in its group, and ``total``, that of the group."""
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max(F.length("key")).alias("longest")).first()
    top = _common(ends.low, ends.high)

    def up(digits: int) -> int:
        return digits + 2 if digits else 1

    depth = top
    while (rows.groupBy("g", _prefix("key", depth)).count().agg(F.max("count")).first()[0] or 0) > bin_:
        if depth >= ends.longest:
            raise ValueError("keys within a group must differ")
        depth = up(depth)
    bins = common.durable(rows.groupBy("g", _prefix("key", depth).alias("at")).agg(F.sum("n").alias("n")), "merkle")
    levels = [(depth, bins)]
    while levels[-1][0] > top:
        digits = max(levels[-1][0] - 2, 0)
        levels.append((digits, levels[-1][1].groupBy("g", _prefix("at", digits).alias("at")).agg(F.sum("n").alias("n"))))


    start = levels[-1][1].select("g", "at", F.lit(0).cast("long").alias("start"), F.col("n").alias("total"))
    for (digits, _), (_, level) in zip(levels[:0:-1], levels[-2::-1], strict=True):
        before = Window.partitionBy("g", "above").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        inner = level.withColumn("above", _prefix("at", digits)).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        start = inner.join(start.withColumnRenamed("at", "above"), ["g", "above"]).select("g", "at", (F.col("start") + F.col("before")).alias("start"), "total")
    within = Window.partitionBy("g", "at").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", _prefix("key", depth)).withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.join(start, ["g", "at"]).withColumn("rank", F.col("start") + F.col("within")).drop("at", "start", "within")


def _spread_copies(ranked: DataFrame) -> DataFrame:
    """A row for each of the n equal rows that a row stands for; many of them are dealt over the tasks in pieces."""
    one = ranked.where(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pieces = ranked.where(F.col("n") > CHUNK).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    pieces = pieces.repartition("g", "rank", "from")
    many = pieces.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, "n") - 1))).drop("from")
    return one.unionByName(many).withColumn("rank", F.col("rank") + F.col("copy")).drop("n", "copy")


def _runs(nodes: DataFrame, fanout: int, kept: list[str]) -> DataFrame:
    """(g, i, total, kids): the nodes of one parent by rank; total counts the nodes of the level."""
    kid = F.struct("rank", "h", *kept)
    runs = nodes.where("total > 1").groupBy("g", F.floor(F.col("rank") / fanout).cast("long").alias("i"))
    return common.durable(runs.agg(F.max("total").alias("total"), F.sort_array(F.collect_list(kid)).alias("kids")), "merkle")


def _up(nodes: DataFrame, fanout: int, kept: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Runs by level, and (g, h) of what remains in each group."""
    left = nodes.agg(F.max("total")).first()[0] or 0
    levels, tops = [], nodes.where("total = 1").select("g", "h")
    while left > 1:
        levels.append(_runs(nodes, fanout, kept))
        digest = F.sha2(F.concat_ws("", F.col("kids.h")), 256)
        nodes = levels[-1].select("g", F.col("i").alias("rank"), digest.alias("h"), F.ceil(F.col("total") / fanout).cast("long").alias("total"))
        tops = tops.unionByName(nodes.where("total = 1").select("g", "h"))
        left, kept = -(-left // fanout), []
    return levels, tops


def _beside(hashes: str, place: Column) -> Column:
    """What stands left and right of a place among hashes, each as one string."""
    h = F.col(hashes)
    return F.struct(F.array_join(F.slice(h, F.lit(1), place), "").alias("left"), F.array_join(F.slice(h, place + 2, F.greatest(F.size(h) - place - 1, F.lit(0))), "").alias("right"))


def _down(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame | None:
    """The lowest runs with ``path``, the siblings above them from below to the root, and what ``tops`` (g, path, ...) has."""
    given = [c for c in tops.columns if c not in ("g", "path")]
    found = None
    for runs in reversed(levels):
        last = runs.where(F.col("total") <= fanout).join(tops, "g")
        if found is not None:
            above = found.select("g", F.col("i").alias("above"), F.col("kids.h").alias("beside"), F.col("path").alias("rest"), *given)
            inner = runs.where(F.col("total") > fanout).withColumn("above", F.floor(F.col("i") / fanout).cast("long")).join(above, ["g", "above"])
            step = F.concat(F.array(_beside("beside", (F.col("i") % fanout).cast("int"))), F.col("rest"))
            last = last.unionByName(inner.select("g", "i", "total", "kids", step.alias("path"), *given))
        found = last
    return found


def _each(runs: DataFrame, given: list[str], kept: list[str]) -> DataFrame:
    """A row for each child of the runs, its own siblings in front of the path."""
    kids = runs.select("g", F.col("kids.h").alias("hs"), "path", *given, F.posexplode("kids").alias("place", "kid"))
    path = F.concat(F.array(_beside("hs", F.col("place"))), F.col("path"))
    return kids.select("g", F.col("kid.h").alias("h"), path.alias("path"), *given, *(F.col(f"kid.{c}").alias(c) for c in kept))


def manifest(docs: DataFrame, fanout: int = FANOUT, bin_: int = BIN, tampered: Column | None = None) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``docs`` has the columns of ``FIELDS``.  ``tampered`` tells which rows are
    folded with the lower-cased text instead of their own.
    """
    at = [F.col(f) if f != "doc_id" else F.col(f).cast("long") for f in FIELDS]
    lowered = [*at[:-1], F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)]
    other = F.when(tampered, leaf_digest(lowered)) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source_key(F.col("source")).alias("g"), leaf_digest(at).alias("h"), other.alias("other"))
    equal = common.durable(leaves.groupBy("g", "doc_id", "h", "other").agg(F.count("*").alias("n")), "merkle")
    ranked = radix_ranks(equal.withColumn("key", F.concat(_id_key("doc_id"), F.col("h"))), bin_).drop("key")
    leaves = common.durable(_spread_copies(ranked), "merkle")

    levels, subroots = _up(leaves, fanout, ["doc_id", "other"])
    sources = common.durable(subroots, "merkle")
    of_sources = common.durable(radix_ranks(sources.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("h"), F.lit(1).cast("long").alias("n")), bin_), "merkle")
    source_levels, root = _up(of_sources, fanout, ["key"])
    root = root.select("g", F.col("h").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    alone = of_sources.where("total = 1").join(root, "g").select(F.col("key").alias("g"), F.col("h").alias("subroot"), "root", "path")
    runs = _down(source_levels, root, fanout)
    tops = alone if runs is None else alone.unionByName(_each(runs, ["root"], ["key"]).select(F.col("key").alias("g"), F.col("h").alias("subroot"), "root", "path"))
    tops = common.durable(tops, "merkle")

    lone = leaves.where("total = 1").select("g", "h", "doc_id", "other").join(tops, "g")
    runs = _down(levels, tops, fanout)
    every = lone if runs is None else lone.unionByName(_each(runs, ["subroot", "root"], ["doc_id", "other"]))
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate("path", F.coalesce("other", "h"), lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))
    out = every.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest, with the rows tampered with whose id has a checksum that ``every`` divides."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0
    return manifest(docs, tampered=F.coalesce(hit, F.lit(False)))
