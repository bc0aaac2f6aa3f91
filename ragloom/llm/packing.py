"""Best-fit packing by bin completion.

Documents become token pieces of at most ``CAPACITY``; what decides a packing
is only how many pieces have each length, and lengths are bounded.  So the
corpus is reduced to a histogram of at most ``CAPACITY`` counts, the driver
searches on it, and a filling that is found is applied as often as its lengths
last.  The search's work does not grow with the corpus.

Search: the largest remaining length opens a bin; undominated fillings of the
rest are enumerated, the least waste first, starting from the best-fit filling
as incumbent and pruned by waste bounds.  Complete packings from best-fit
fillings and from least-waste fillings are the first incumbents.  Branching
goes by discrepancy: first packings that leave the least-waste filling once,
wherever that is, then twice, and so on, so that effort is spread from the first
bin to the last.  It ends when ``lower_bound`` is met, when all is searched, or
when ``NODES`` fillings were tried; the last case is logged with both numbers.
A node enumerates up to ``MOST``
fillings in ``STEPS`` steps; fillings of more than ``TESTED`` pieces are not
tested for dominance, which only lets more of them through.

Pieces get their place by rank: within a task as they are written, plus the
counts of the tasks before it, so no window gathers a length in one task.

Defined results: a null or empty text is the closing id alone; repeated rows
are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import zlib
from array import array
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

CAPACITY, CLOSING = 2048, 0
#: Bounds of the search, on the driver, whatever the corpus.
NODES, MOST, STEPS, TESTED = 40_000, 4, 4000, 8
_LOG = logging.getLogger(__name__)


class ByteEncoder:
    """Ids of ``tokenizers`` for a byte-level BPE file, as packed little-endian unsigned 32-bit integers.

    The file's ids are its merge ranks, so ``tiktoken`` encodes single words
    from the same vocabulary; words are kept.  Special tokens in a text become
    their ids, as the library does.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        byte = {c: b for b, c in enumerate(words.byte_alphabet())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("words", pat_str=words.BYTE_ANY.pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        single = self.bpe._core_bpe.encode_single_piece
        self.word = lambda w: array("I", single(w.encode("utf-8", "surrogatepass"))).tobytes()
        self.kept = words.Kept(self._piece)

    def _piece(self, text: str) -> bytes:
        found = words.byte_words(text)
        return self.word(text) if len(found) == 1 else b"".join(map(self.word, found))

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.kept.recall().__getitem__, words.byte_stretches(text)))

    def __call__(self, text: str) -> bytes:
        if "<|" not in text:
            return self._words(text)
        return b"".join(self.special.get(part) or self._words(part) for part in self.split.split(text) if part)


# -- search ----------------------------------------------------------------


def best_fit(counts: np.ndarray, room: int) -> list[int]:
    """Largest length first, as it fits."""
    left, out = counts.copy(), []
    for size in np.flatnonzero(left[: room + 1])[::-1].tolist():
        n = min(int(left[size]), room // size)
        out += [size] * n
        room -= n * size
        if not room:
            break
    return out


def _dominated(filling: tuple, slack: int, counts: np.ndarray) -> bool:
    """Whether one unused length could take the place of two or more of the filling, wasting no more."""
    if len(filling) > TESTED:
        return False
    used = Counter(filling)
    sums = {0: 0}
    for x in filling:
        for s, n in list(sums.items()):
            sums[s + x] = max(sums.get(s + x, 0), n + 1)
    for s, n in sums.items():
        if n >= 2:
            for x in range(s, s + slack + 1):
                if x < len(counts) and counts[x] > used.get(x, 0):
                    return True
    return False


def fillings(counts: np.ndarray, room: int, most: int = MOST, steps: int = STEPS) -> list[tuple]:
    """Up to ``most`` undominated fillings of ``room``, least waste first; the best-fit one is the incumbent that bounds waste."""
    if room and counts[room]:
        return [(room,)]  # one document that fills the rest dominates every other filling
    sizes = np.flatnonzero(counts[: room + 1])[::-1]
    fits = (len(sizes) - np.searchsorted(sizes[::-1], np.arange(room + 1), side="right")).tolist()  # first place of a length that fits
    sizes = sizes.tolist()
    have = [int(counts[s]) for s in sizes]
    reach = np.cumsum([s * min(h, room // s + 1) for s, h in zip(sizes, have, strict=True)][::-1])[::-1].tolist()  # all that is left from here on
    incumbent = tuple(best_fit(counts, room))
    best = room - sum(incumbent)
    found = {incumbent: best}
    dead: set = set()
    todo = [(room, 0, ())]
    while todo and steps:
        steps -= 1
        left, i, chosen = todo.pop()
        i = max(i, fits[left])
        if i == len(sizes):
            if left <= best and chosen not in found and not _dominated(chosen, left, counts):
                best = min(best, left)
                found[chosen] = left
                if sum(w == 0 for w in found.values()) >= most:
                    break
            continue
        if left - reach[i] > best or (left, i) in dead:
            continue
        dead.add((left, i))
        for n in range(0, min(have[i], left // sizes[i]) + 1):  # pushed in this order: most copies are tried first
            todo.append((left - n * sizes[i], i + 1, chosen + (sizes[i],) * n))
    return [f for f, _ in sorted(found.items(), key=lambda x: (x[1], len(x[0])))][:most]


def _apply(counts: np.ndarray, pattern: Counter) -> int:
    times = min(int(counts[s]) // n for s, n in pattern.items())
    for s, n in pattern.items():
        counts[s] -= times * n
    return times


def _dive(counts: np.ndarray, room: int, fill) -> list[tuple[tuple, int]]:
    counts, out = counts.copy(), []
    while counts.any():
        first = int(np.flatnonzero(counts)[-1])
        counts[first] -= 1
        rest = fill(counts, room - first)
        counts[first] += 1
        pattern = (first, *rest)
        out.append((pattern, _apply(counts, Counter(pattern))))
    return out


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing uses fewer bins: for each k, pieces above half a bin have a bin each, and those above
    capacity - k leave no room for pieces of k or more; what of the latter the other bins cannot hold needs more."""
    counts = np.asarray(counts, np.int64)
    n, total = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * np.arange(len(counts))))
    upto = lambda x: min(x + 1, len(counts))  # noqa: E731  # pieces of up to x are before this place
    half, every = upto(capacity // 2), len(counts)
    best = -(-int(total[every]) // capacity)
    for k in range(1, capacity // 2 + 1):
        large, small = upto(capacity - k), min(k, every)
        middle = int(n[large] - n[half])
        over = int(total[half] - total[small]) - (middle * capacity - int(total[large] - total[half]))
        best = max(best, int(n[every] - n[half]) + max(0, -(-over // capacity)))
    return best


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple, int]]:
    """(filling, times) that use up ``counts`` (index: length) in as few bins as the search finds."""
    counts = np.asarray(counts, np.int64)
    size = np.arange(len(counts))
    least = lambda c: -(-int((c * size).sum()) // capacity)
    bound, used = lower_bound(counts, capacity), lambda plan: sum(t for _, t in plan)
    best = min((_dive(counts, capacity, best_fit), _dive(counts, capacity, lambda c, r: fillings(c, r, 1)[0])), key=used)
    allowed, cut = 0, True
    while cut and nodes > 0 and used(best) > bound:
        cut, todo = False, [(counts.copy(), [], 0, allowed)]
        while todo and nodes > 0 and used(best) > bound:
            left, plan, bins, free = todo.pop()
            if not left.any():
                if bins < used(best):
                    best = plan
                continue
            if bins + least(left) >= used(best):
                continue
            first = int(np.flatnonzero(left)[-1])
            left[first] -= 1
            choices = fillings(left, capacity - first)
            left[first] += 1
            nodes -= len(choices)
            cut |= len(choices) > 1 and free == 0
            for n, rest in reversed(list(enumerate(choices if free else choices[:1]))):
                pattern, after = (first, *rest), left.copy()
                times = _apply(after, Counter(pattern))
                todo.append((after, [*plan, (pattern, times)], bins + times, free - (n > 0)))
        allowed += 1
    if used(best) > bound:
        _LOG.warning("packing uses %d sequences, the lower bound is %d%s", used(best), bound, "" if nodes > 0 else "; the search ended by its limit")
    return best


class Places:
    """Where the k-th piece of each length goes: arrays bounded by the fillings, which the lengths bound."""

    def __init__(self, plan: list[tuple[tuple, int]]):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        rank: Counter = Counter()
        bin_ = 0
        for pattern, times in plan:
            offset = 0
            for s in pattern:
                by.setdefault(s, []).append((rank[s], bin_, offset, times))
                rank[s] += times
                offset += s
            bin_ += times
        self.by = {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in by.items()}

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        names, begins = np.unique(lengths[order], return_index=True)
        for s, rows in zip(names, np.split(order, begins[1:]), strict=True):
            first, bin_, offset, _ = self.by[int(s)]
            at = np.searchsorted(first, ranks[rows], side="right") - 1
            seq[rows] = bin_[at] + ranks[rows] - first[at]
            off[rows] = offset[at]
        return seq, off


# -- on the cluster --------------------------------------------------------

_ENCODERS: dict[str, ByteEncoder] = {}


def _encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def _pieces(batches, path: str, capacity: int):
    encode = _encoder(path)
    closing, part, ranks = np.array([CLOSING], "<u4").tobytes(), TaskContext.get().partitionId(), Counter()
    for b in batches:
        out: list[tuple] = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = encode(text or "") + closing
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out.append((doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), part, ranks[e - s]))
                ranks[e - s] += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of the byte-level BPE file, the same on all machines.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, part long, rank long"
    pieces = common.durable(rows.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity), schema), "pieces")
    by_task = common.durable(pieces.groupBy("length", "part").count(), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        counts[length] = n
    places = spark.sparkContext.broadcast(Places(bin_completion(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # the table of lengths and tasks grows with the corpus, so it is never broadcast; a piece's row is a few numbers
    ranked = pieces.join(firsts.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches):
        for b in batches:
            seq, off = places.value(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:1], b.column("piece").cast(pa.int32()), *b.columns[2:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
