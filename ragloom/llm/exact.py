"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by successive bytes until a group is a singleton or its texts
have ended; equality is read off the bytes themselves, without any digest.

1. Where a text is read, its white space is normalised and the rows of one
   Arrow batch are split by the radix recursion, so that copies in a batch
   become one representative before anything is shuffled.
2. Representatives are dealt by their leading bytes.  A leading digit that
   holds more than a fair share of the bytes (what a task would get if all were
   dealt evenly, from ``LEAST_BYTES`` to ``GROUP_BYTES``) is split by more
   bytes, in as many rounds as it takes.  What has ended within the digit, so
   that the digit is the whole text, is a group of copies, and an aggregation
   with map-side combining resolves it, however large.
3. Each remaining group is a small part of a task, where the recursion ends it.

Defined results: null is empty, empty texts equal each other; of repeated rows
exactly one stays; a null doc_id sorts behind all others; an empty table gives
an empty one; clashing column names are kept apart, as rows travel in a struct.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Most and least bytes of a leading digit that is not split further.
GROUP_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
DEPTHS = tuple(32 * 16**k for k in range(7))
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def normalise(text: str | None) -> bytes:
    """Runs of ASCII white space become one space each."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_SPACES)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def radix_groups(texts: list[bytes], depth: int = 0) -> list[list[int]]:
    """Places of equal texts, by MSD recursion from byte ``depth`` on (all agree before it); digits widen as groups shrink."""
    done: list[list[int]] = []
    todo = [(list(range(len(texts))), depth, 8)]
    while todo:
        members, at, width = todo.pop()
        if len(members) == 1:
            done.append(members)
            continue
        ended = [i for i in members if len(texts[i]) <= at]
        if ended:
            done.append(ended)
        digits: dict[bytes, list[int]] = {}
        for i in members:
            if len(texts[i]) > at:
                digits.setdefault(texts[i][at : at + width], []).append(i)
        todo += [(m, at + width, width * 8) for m in digits.values()]
    return done


def _sorted_first(pairs):
    """The least (id, row), null ids last."""
    return min(pairs, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _collapse(docs: DataFrame, key: str, text: str, carry: bool) -> DataFrame:
    """A row per document; of each batch's equal texts the first holds the text and what its group has."""
    common.small_batches(docs.sparkSession)
    cols = [F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("value")]
    rows = docs.select(*cols, *([F.struct(*docs.columns).alias("row")] if carry else []))

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, data = b.column("id").to_pylist(), [normalise(t) for t in b.column("value").to_pylist()]
            n = len(ids)
            rep, held, least, least_row, copies = [0] * n, [None] * n, [None] * n, [None] * n, [None] * n
            for group in radix_groups(data):
                first = group[0]
                least[first], least_row[first] = _sorted_first((ids[i], at + i) for i in group)
                held[first], copies[first] = data[first], len(group)
                for i in group:
                    rep[i] = at + first
            digest = [hashlib.sha256(t).hexdigest() for t in data]
            out = [b.column("id"), pa.array(range(at, at + n), pa.int64()), pa.array(rep, pa.int64()), pa.array(digest, pa.string()), pa.array(held, pa.binary()), pa.array(least, pa.int64()), pa.array(least_row, pa.int64()), pa.array(copies, pa.int64())]
            names = ["id", "rid", "rep", "sha", "norm", "least", "least_rid", "copies"]
            if carry:
                out, names = [*out, b.column("row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(out, names)
            at += n

    schema = "id long, rid long, rep long, sha string, norm binary, least long, least_rid long, copies long"
    if carry:
        from pyspark.sql.types import StructType

        return rows.mapInArrow(run, StructType.fromDDL(schema).add("row", docs.schema))
    return rows.mapInArrow(run, schema)


_FOUND = "rep long, keep_id long, keep_rid long, group_size long"


def _solved(batches, depth: int):
    """Groups of equal texts among rows sorted by their first ``depth`` bytes."""
    held: list[list] = [[], [], [], [], []]  # rep, norm, least, least_rid, copies

    def packed():
        rep, texts, least, least_rid, copies = held
        out: list[list] = [[], [], [], []]
        for group in radix_groups(texts):
            keep, keep_rid = _sorted_first((least[i], least_rid[i]) for i in group)
            size = sum(copies[i] for i in group)
            out[0] += [rep[i] for i in group]
            for column, value in zip(out[1:], (keep, keep_rid, size), strict=True):
                column += [value] * len(group)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rep", "keep_id", "keep_rid", "group_size"])

    size, last = 0, None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("rep", "norm", "least", "least_rid", "copies")]
        first = 0
        for i, text in enumerate(columns[1]):
            digit = text[:depth]
            if size > 4 << 20 and digit != last:  # only between digits
                for h, c in zip(held, columns, strict=True):
                    h += c[first:i]
                yield from packed()
                held, size, first = [[], [], [], [], []], 0, i
            size, last = size + len(text), digit
        for h, c in zip(held, columns, strict=True):
            h += c[first:]
    yield from packed()


def _finish(light: DataFrame, depth: int) -> DataFrame:
    """Groups of leading digits that are small parts of a task."""
    digit = F.substring("norm", 1, depth)
    return light.repartition(digit).sortWithinPartitions(digit).select("rep", "norm", "least", "least_rid", "copies").mapInArrow(partial(_solved, depth=depth), _FOUND)


def _resolve(reps: DataFrame, group_bytes: int | None) -> DataFrame:
    found: list[DataFrame] = []
    todo = reps
    for depth in (*DEPTHS, 1 << 30):
        dealt = todo.withColumn("digit", F.substring("norm", 1, depth))
        sizes = dealt.groupBy("digit").agg(F.sum(F.length("norm")).alias("bytes"), F.max(F.length("norm")).alias("longest"))
        if group_bytes is None:
            tasks = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            every = reps.agg(F.sum(F.length("norm"))).first()[0] or 0
            group_bytes = min(GROUP_BYTES, max(LEAST_BYTES, every // tasks))
        heavy = common.durable(sizes.where(F.col("bytes") > group_bytes), "radix")
        if heavy.isEmpty():
            found.append(_finish(todo, depth))
            break
        found.append(_finish(dealt.join(heavy.select("digit"), "digit", "left_anti").drop("digit"), depth))
        # of a heavy digit, the texts that have ended are copies of each other; the others go on
        ended = dealt.join(heavy.select("digit"), "digit", "left_semi").where(F.length("norm") <= depth)
        order = F.min(F.struct(F.col("least").isNull().alias("z"), F.col("least").alias("k"), F.col("least_rid").alias("r")))
        whole = ended.groupBy("digit").agg(order.alias("first"), F.sum("copies").alias("group_size"))
        found.append(ended.select("rep", "digit").join(whole, "digit").select("rep", F.col("first.k").alias("keep_id"), F.col("first.r").alias("keep_rid"), "group_size"))
        longer = heavy.where(F.col("longest") > depth).select("digit")
        if longer.isEmpty():
            break
        todo = common.durable(dealt.where(F.length("norm") > depth).join(longer, "digit", "left_semi").drop("digit"), "radix")
    return reduce(DataFrame.unionByName, found)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", group_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (reported, not used to compare)."""
    rows = common.durable(_collapse(docs, key, text, carry=False), "exact")
    reps = rows.where("norm is not null").select("rep", "norm", "least", "least_rid", "copies")
    joined = rows.select("id", "rid", "rep", "sha").join(_resolve(reps, group_bytes), "rep")
    return joined.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", group_bytes: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    rows = common.durable(_collapse(docs, key, text, carry=True), "exact")
    reps = rows.where("norm is not null").select("rep", "norm", "least", "least_rid", "copies")
    found = _resolve(reps, group_bytes).select("rep", "keep_rid")
    # the rows that go, by number alone and written: their size decides whether texts are shuffled to meet them
    dropped = common.durable(rows.select("rid", "rep").join(found, "rep").where(F.col("rid") != F.col("keep_rid")).select("rid"), "exact")
    return rows.select("rid", "row").join(dropped, "rid", "left_anti").select("row.*")
