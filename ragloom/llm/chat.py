"""Chat formatting: roles from a hidden Markov model, then canonical turns.

Transcripts are parsed into blocks: a text is cut before every line that opens
with a speaker marker.  The states are roles.  A block shows a speaker marker
at its start (or none), a length, and whether it ends with a question; these
and the order of roles are counted over labelled conversations, aggregated
where they lie.  Viterbi finds the likeliest roles of each conversation.

A conversation may hold a third of all rows, so none is gathered in one task:
rows are sorted by conversation and turn over the cluster and cut into chunks
of ``CHUNK`` blocks by their place in the conversation.  Each chunk is reduced
to a matrix of best scores from the role before it to its last role.  Only
these matrices meet, once for every ``CHUNK`` blocks, to fix the roles at chunk
borders; then each chunk is decoded by itself.  Scores are whole numbers and
ties are broken alike everywhere (of equal paths the one whose last role, then
last but one, ..., is least), so the result is that of Viterbi over the whole
and depends on neither partitions nor ``CHUNK``.

Defined results: a null text is one empty block; rows without a conv_id form
one conversation; null turns come first, equal turns are ordered by text; a
row's role is that of its first block, the others' role is null; repeated rows
each get their rows; with no labelled rows the markers alone decide; an empty
table gives an empty result; clashing input columns are not read.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
CHUNK = 4096
#: Log scores are kept as whole numbers of this part of one.
SCALE = 1 << 20
#: Speaker names at the start of a line, by role.
MARKERS = (("system", "instructions"), ("user", "human", "customer", "question", "q"), ("assistant", "ai", "bot", "model", "agent", "answer", "a"))
LENGTHS = 14
_OPEN, _CLOSE = r"[\[<#*\s|]*", r"[\]>*|]*\s*[:>\]]\s*"


def _marked(names) -> str:
    return rf"(?i)^{_OPEN}(?:{'|'.join(names)}){_CLOSE}"


def symbol(text: Column) -> Column:
    """Line features as one number: marker * 2 * LENGTHS + question * LENGTHS + length step."""
    marker = F.coalesce(*[F.when(text.rlike(_marked(n)), F.lit(i)) for i, n in enumerate(MARKERS)], F.lit(len(ROLES)))
    length = F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.length(text) + 1.0) * 1.25).cast("int"))
    return (marker * 2 * LENGTHS + F.when(F.rtrim(text).endswith("?"), LENGTHS).otherwise(0) + length).cast("int")


def cut_blocks(text: Column) -> Column:
    """The blocks of a transcript: it is cut before every line that opens with a speaker marker."""
    every = "|".join(n for names in MARKERS for n in names)
    return F.split(F.coalesce(text.cast("string"), F.lit("")), rf"(?i)\n(?=[\[<#*\t |]*(?:{every}){_CLOSE})")


class Model:
    """Log scores as whole numbers: ``start`` by role, ``step`` from role to role, ``show`` by role and symbol."""

    def __init__(self, seen: np.ndarray, steps: np.ndarray, starts: np.ndarray):
        """Counts by (role, symbol), (role, role) and (role)."""
        n = len(ROLES)
        shape = seen.reshape(n, n + 1, 2 * LENGTHS)
        marker = shape.sum(2) + 0.01
        marker[np.arange(n), np.arange(n)] += 0.05 * seen.sum(1) + 1  # a marker names its role, also where none was seen
        marker[:, n] += 1
        form = shape.sum(1) + 0.2
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        whole = lambda x: np.round(x * SCALE).astype(np.int64)
        self.show = whole((log(marker)[:, :, None] + log(form)[:, None, :]).reshape(n, -1))
        self.step = whole(log(steps + 0.2))
        self.start = whole(log(starts + 0.2))

    def reduce(self, symbols: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(best, rank): best[i, j] is the best score that ends in role j, from role i before; one row if it is the first chunk.

        rank[i, j] orders the paths of a role j: the least is the one that ties go to.
        """
        show = self.show[:, symbols].T
        best, back = ((self.start if first else self.step) + show[0]).reshape(-1, len(ROLES)), []
        for row in show[1:]:
            come = best[:, :, None] + self.step[None]
            back.append(come.argmax(1))  # the least role of equal ones
            best = come.max(1) + row
        rank = np.zeros(best.shape, np.int64)
        for j in range(best.shape[1]):
            paths = []
            for i in range(best.shape[0]):
                role, path = j, []
                for step in reversed(back):
                    role = int(step[i, role])
                    path.append(role)
                paths.append((path, i))
            for place, (_, i) in enumerate(sorted(paths)):
                rank[i, j] = place
        return best, rank

    def decode(self, symbols: np.ndarray, before: int, last: int) -> list[int]:
        """Likeliest roles; ``before`` (-1: the conversation begins) and ``last`` (-1: free) are given."""
        show = self.show[:, symbols].T.tolist()
        step, n = self.step.tolist(), len(ROLES)
        best = [a + b for a, b in zip(self.start.tolist() if before < 0 else step[before], show[0], strict=True)]
        back = []
        for row in show[1:]:
            come = [max(range(n), key=lambda i: (best[i] + step[i][j], -i)) for j in range(n)]
            best = [best[come[j]] + step[come[j]][j] + row[j] for j in range(n)]
            back.append(come)
        role = last if last >= 0 else max(range(n), key=lambda i: (best[i], -i))
        roles = [role]
        for come in reversed(back):
            role = come[role]
            roles.append(role)
        return roles[::-1]


def fix_borders(chunks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(chunk, role before it or -1, its last role) from the (chunk, best, rank) of a conversation, in order."""
    score, come = None, []
    for _, best, rank in chunks:
        whole = best if score is None else score[:, None] + best
        score = whole.max(0)
        come.append(np.where(whole == score, rank, len(ROLES)).argmin(0))
    last, out = int(score.argmax()), []
    for (chunk, _, _), c in zip(reversed(chunks), reversed(come), strict=True):
        before = -1 if chunk == chunks[0][0] else int(c[last])
        out.append((chunk, before, last))
        last = before
    return out


def chunked(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, block, role, text, symbol, chunk, pos): blocks, with their place in their conversation."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = F.xxhash64("text")
    ranged = rows.repartitionByRange(parts, "conv_id", "turn", digest).sortWithinPartitions("conv_id", "turn", digest, "text", "role")
    blocks = ranged.select("conv_id", "turn", "role", F.posexplode(cut_blocks(F.col("text"))).alias("block", "text"))
    blocks = blocks.select("conv_id", "turn", "block", F.when(F.col("block") == 0, F.col("role")).alias("role"), "text", symbol(F.col("text")).alias("symbol"))
    common.small_batches(turns.sparkSession)

    def run(batches):
        part, at, conv = TaskContext.get().partitionId(), 0, "none yet"
        for b in batches:
            places = []
            for c in b.column("conv_id").to_pylist():
                if c != conv:
                    at, conv = 0, c
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], [*b.schema.names, "part", "place"])

    # written, as the places hold for this one computation of the partitions
    placed = common.durable(blocks.mapInArrow(run, "conv_id long, turn long, block int, role string, text string, symbol int, part int, place long"), "chat")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("conv_id", "part").count().select("conv_id", "part", F.sum("count").over(before).alias("first"))
    # a conversation that goes on in a later partition: one row for each partition at the most
    later = F.broadcast(runs.where("first > 0").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first"))
    place = F.col("place") + F.coalesce("first", F.lit(0))
    joined = placed.join(later, placed.conv_id.eqNullSafe(later.c) & (placed.part == later.p), "left")
    return joined.select("conv_id", "turn", "block", "role", "text", "symbol", F.floor(place / chunk).alias("chunk"), (place % chunk).cast("int").alias("pos"))


def train(rows: DataFrame) -> Model:
    """Counts over labelled blocks outside the held-out fold of conversations; a few hundred numbers reach the driver."""
    role = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(ROLES)])
    use = rows.where("conv_id is null or pmod(crc32(cast(conv_id as string)), 5) <> 0").withColumn("r", role)
    n = len(ROLES)
    seen, steps, starts = np.zeros((n, (n + 1) * 2 * LENGTHS)), np.zeros((n, n)), np.zeros(n)
    for r in use.where("r is not null").groupBy("r", "symbol").count().collect():
        seen[r.r, r.symbol] = r["count"]
    before = F.lag("r").over(Window.partitionBy("conv_id", "chunk").orderBy("pos"))  # a chunk is at most CHUNK rows
    inside = use.select("r", before.alias("b"), "pos").where("pos > 0").select("b", "r", F.lit(False).alias("opens"))
    # one row a chunk: its first role follows the last one of its conversation's chunk before
    ends = use.groupBy("conv_id", "chunk").agg(F.min_by("r", "pos").alias("r"), F.max_by("r", "pos").alias("last"))
    borders = ends.select(F.lag("last").over(Window.partitionBy("conv_id").orderBy("chunk")).alias("b"), "r", (F.col("chunk") == 0).alias("opens"))
    for r in inside.unionByName(borders).where("r is not null").groupBy("b", "r", "opens").count().collect():
        if r.opens:
            starts[r.r] += r["count"]
        elif r.b is not None:
            steps[r.b, r.r] += r["count"]
    return Model(seen, steps, starts)


def _by_chunk(batches):
    """Whole chunks from rows sorted by (conv_id, chunk, pos), as tables."""
    held, key = [], None
    for b in batches:
        conv, ids = b.column("conv_id"), b.column("chunk").to_numpy()
        filled, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        change = (ids[1:] != ids[:-1]) | (filled[1:] != filled[:-1]) | (null[1:] != null[:-1])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)] if len(ids) else [0]
        for s, e in zip(cuts, cuts[1:], strict=False):
            mine = (int(ids[s]), int(filled[s]), bool(null[s]))
            if held and mine != key:
                yield pa.Table.from_batches(held)
                held = []
            key = mine
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def recover_roles(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, turn, block, role, found_role, rendered): a row per block, its given role beside the one found."""
    spark = turns.sparkSession
    rows = chunked(turns, chunk)
    model = spark.sparkContext.broadcast(train(rows))
    # only conversations of several chunks need their borders fixed
    several = common.durable(rows.where("chunk = 1 and pos = 0").select(F.col("conv_id").alias("c")), "chat")
    narrow = rows.select("conv_id", "chunk", "pos", "symbol").join(several, rows.conv_id.eqNullSafe(several.c), "left_semi")

    def reduce(batches):
        for t in _by_chunk(batches):
            number = t["chunk"][0].as_py()
            best, rank = model.value.reduce(t["symbol"].to_numpy(), number == 0)
            lists = [pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (best, rank)]
            yield pa.RecordBatch.from_arrays([pa.array([t["conv_id"][0].as_py()], pa.int64()), pa.array([number], pa.int64()), *lists], ["conv_id", "chunk", "best", "rank"])

    matrices = common.durable(narrow.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(reduce, "conv_id long, chunk long, best array<long>, rank array<long>"), "chat")

    def borders(batches):
        def all_rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "chunk", "best", "rank")), strict=True)

        for conv, group in groupby(all_rows(), key=lambda r: r[0]):
            shaped = [(k, *(np.array(x, np.int64).reshape(-1, len(ROLES)) for x in (best, rank))) for _, k, best, rank in group]
            found = fix_borders(shaped)
            columns = [pa.array([conv] * len(found), pa.int64()), *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["c", "k", "before", "last"])

    ends = common.durable(matrices.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(borders, "c long, k long, before int, last int"), "chat")
    bounded = rows.select("conv_id", "chunk", "pos", "symbol").join(ends, rows.conv_id.eqNullSafe(ends.c) & (rows.chunk == ends.k), "left")
    bounded = bounded.select("conv_id", "chunk", "pos", "symbol", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"))

    def decode(batches):
        for t in _by_chunk(batches):
            roles = model.value.decode(t["symbol"].to_numpy(), t["before"][0].as_py(), t["last"][0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([t["conv_id"][0].as_py()], pa.int64()), pa.array([t["chunk"][0].as_py()], pa.int64()), pa.array([[int(r) for r in roles]], pa.list_(pa.int8()))], ["c", "k", "roles"])

    # a chunk's roles are one row, which its blocks meet again: texts are never gathered
    decoded = common.durable(bounded.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(decode, "c long, k long, roles array<tinyint>"), "chat")
    named = F.array(*[F.lit(r) for r in ROLES])
    found = rows.join(decoded, rows.conv_id.eqNullSafe(decoded.c) & (rows.chunk == decoded.k)).withColumn("found_role", named[F.col("roles")[F.col("pos")]])
    return found.select("conv_id", "turn", "block", "role", "found_role", render(F.col("found_role"), F.col("text")).alias("rendered"))


def render(role: Column, text: Column) -> Column:
    """A canonical turn: the role's tag, the text without its speaker marker, an end tag."""
    every = [n for names in MARKERS for n in names]
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(F.regexp_replace(text, _marked(every), "")), F.lit("\n<|end|>"))
