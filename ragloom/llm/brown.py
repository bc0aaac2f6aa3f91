"""Language-model scores by class bigrams with Brown's exchange clustering.

The model gives a token the probability of its class behind the class of the
token before it, times that of the token in its class.  Texts end with one end
token, which has a class of its own and also stands before the first word.

1. Documents are written once, dealt into blocks of about ``BLOCK`` bytes.
2. Frequent words are those with at least one in ``FREQUENT`` training tokens.
   There can be no more than ``FREQUENT`` of them, and their letters are no more
   than ``FREQUENT`` mean words, so they are broadcast.  Other words can be no
   hot keys, so they are dealt by word.  A word that is frequent has half its
   share in some piece of a task's texts at least; only such words are sent.
3. Neighbours of frequent words are counted over the whole corpus.
4. Exchange clustering: in each round, tasks move some of the frequent words,
   by a hash, to the class where the class bigrams' likelihood gains most.  As
   a round moves many words at once, one that makes the likelihood fall is
   taken back, and from then on rounds move half as many.
5. Every other word goes with the classes around it, block by block, to the task
   that has the word.  There it is counted and exchanged once, and count and
   class go back to each block.
6. A block's task turns its documents into one class number a token.
7. Class bigrams are counted from these over all training documents, and every
   document is scored.

In a class, words have their counts less an absolute discount; what is taken
off goes to one unknown word.  Transitions are smoothed towards the classes'
shares.  So the probabilities of all known words, the end and the unknown word
sum to one behind each class.

Defined results: null and empty texts are one end token; a null doc_id is not
held out; repeated rows each get their row and are counted each; an empty
table gives an empty result; where nothing is left to learn from, both scores
are zero, as all is one unknown word; clashing input columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASSES, FREQUENT, ROUNDS, PARTS = 64, 1 << 16, 12, 3
#: What each word's count gives to the unknown word.
DISCOUNT = 0.75
#: Bytes of text in a block, and distinct words or tokens that a task holds before it passes them on.
BLOCK, HELD_WORDS, HELD_TOKENS = 8 << 20, 200_000, 1 << 20
#: Class of the end, class of words that are not frequent until they are exchanged, and number of an unknown word.
END, REST, UNKNOWN = 0, 1, 255
_END = b"\n"  # no word holds white space


def words_of(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case; bytes.lower and bytes.split know ASCII only, and the latter splits at \\x09-\\x0d and the space."""
    return text.lower().split()


def _texts(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _blocks(batches):
    """Rows with a block number; a block is a run of rows of one task."""
    from pyspark import TaskContext

    block, size = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        numbers = []
        for n in pc.binary_length(b.column("text").cast(pa.binary())).to_pylist():
            size += n
            numbers.append(block)
            if size >= BLOCK:
                block, size = block + 1, 0
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], [*b.schema.names, "block"])


def _often(batches, frequent: int):
    """(word, n) of a task's training texts, of words with at least 1 / (2 * frequent) of a piece; the null word has all tokens."""
    held: Counter = Counter()
    tokens = 0

    def out():
        most = [(w, n) for w, n in held.items() if 2 * n * frequent >= tokens]
        return pa.RecordBatch.from_arrays([pa.array([None, *(w for w, _ in most)], pa.binary()), pa.array([tokens, *(n for _, n in most)], pa.int64())], ["word", "n"])

    for b in batches:
        for t in _texts(b.column("text")):
            words = words_of(t)
            held.update(words)
            tokens += len(words) + 1
            if len(held) >= HELD_WORDS:
                yield out()
                held, tokens = Counter(), 0
    if tokens:
        yield out()


def _pairs(batches, frequent):
    """(a, b, n): counts of neighbours among numbered words; number 0 is any other word, 1 the end."""
    number = frequent.value.get
    width = len(frequent.value) + 2
    held: list[np.ndarray] = []
    size = 0

    def out():
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((codes // width).astype(np.int32)), pa.array((codes % width).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    for b in batches:
        for t in _texts(b.column("text")):
            words = words_of(t)
            ids = np.fromiter(map(number, words, repeat(0)), np.int64, len(words))
            ids = np.concatenate([[1], ids, [1]])
            held.append(ids[:-1] * width + ids[1:])
            size += len(words) + 1
            if size >= HELD_TOKENS:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _renumbered(batches, numbers):
    for b in batches:
        a, c = (numbers.value[b.column(x).to_numpy()] for x in ("a", "b"))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), b.column("n")], ["a", "b", "n"])


def entropy(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to a constant of the words."""
    return float(entropy(table).sum() - entropy(table.sum(1)).sum() - entropy(table.sum(0)).sum())


def gains(table: np.ndarray, own: int | np.ndarray, after: np.ndarray, before: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Likelihood of each word in each class, up to a constant of the word.

    ``after`` and ``before`` (words, classes) are the counts of classes behind
    and in front of each word, ``again`` those of the word behind itself, and
    ``own`` its class, whose counts in ``table`` hold the word's own.
    """
    m, k = after.shape
    at = np.arange(m)
    own = np.broadcast_to(own, m)
    l, p = after.astype(float), before.astype(float)
    rest = np.broadcast_to(table, (m, k, k)).copy()  # the table without the word
    rest[at, own, :] -= l
    rest[at, :, own] -= p
    rest[at, own, own] += again  # was taken off twice
    l[at, own] -= again
    p[at, own] -= again
    both = np.einsum("mkk->mk", rest)
    inner = l + p + np.asarray(again, float)[:, None]
    row = entropy(rest + l[:, None, :]) - entropy(rest)
    column = entropy(rest + p[:, :, None]) - entropy(rest)
    out = row.sum(2) + column.sum(1) - np.einsum("mkk->mk", row) - np.einsum("mkk->mk", column)
    out += entropy(both + inner) - entropy(both)
    for total, n in ((table.sum(1), after.sum(1)), (table.sum(0), before.sum(1))):
        others = np.broadcast_to(total, (m, k)).copy()
        others[at, own] -= n
        out -= entropy(others + n[:, None]) - entropy(others)
    return out.round(6)  # equal classes stay equal


def _class_counts(neighbours, counts, classes: np.ndarray, k: int) -> np.ndarray:
    """A row of class counts for each list of neighbours."""
    lengths = neighbours.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(neighbours)), lengths)
    code = row * k + classes[np.asarray(neighbours.flatten())]
    return np.bincount(code, np.asarray(counts.flatten()), len(neighbours) * k).reshape(-1, k)


def _cells(batches, classes, k: int):
    """A task's part of the class table: (cell, n)."""
    total = np.zeros(k * k)
    for b in batches:
        after = _class_counts(b.column("after"), b.column("n_after"), classes.value, k)
        np.add.at(total.reshape(k, k), classes.value[b.column("a").to_numpy()], after)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["cell", "n"])


def part_of(numbers: np.ndarray, parts: int) -> np.ndarray:
    """In which of so many rounds a word may move."""
    return numbers * 2654435761 % (1 << 32) * parts >> 32


def _moves(batches, state, part: int, parts: int, k: int):
    """(a, class) of the words of this part that are better off in another class; numbers 0 and 1 stay."""
    classes, table = state.value
    for b in batches:
        a = b.column("a").to_numpy().astype(np.int64)
        for some in np.array_split(np.flatnonzero((a > 1) & (part_of(a, parts) == part)), max(1, b.num_rows // 64)):
            if not len(some):
                continue
            rows = b.take(pa.array(some))
            after = _class_counts(rows.column("after"), rows.column("n_after"), classes, k)
            before = _class_counts(rows.column("before"), rows.column("n_before"), classes, k)
            own = classes[a[some]]
            value = gains(table, own, after, before, rows.column("again").to_numpy())
            value[:, END] = -np.inf
            best = value.argmax(1)
            moved = value[np.arange(len(some)), best] > value[np.arange(len(some)), own]
            yield pa.RecordBatch.from_arrays([pa.array(a[some][moved].astype(np.int32)), pa.array(best[moved].astype(np.int32))], ["a", "class"])


def class_table(cells: DataFrame, k: int) -> np.ndarray:
    table = np.zeros(k * k)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row for each two classes
        table[r.cell] = r.n
    return table.reshape(k, k)


def exchange(spark: SparkSession, pairs: DataFrame, size: int, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the numbers below ``size``, their table, and the likelihood by round, from neighbours (a, b, n)."""
    one = pairs.groupBy(F.col("a").alias("w")).agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("after"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("again"))
    two = pairs.groupBy(F.col("b").alias("w")).agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias("before"))  # at most ``size`` neighbours each
    words = one.join(two, "w").select(F.col("w").alias("a"), F.col("after.b").alias("after"), F.col("after.n").alias("n_after"), F.col("before.a").alias("before"), F.col("before.n").alias("n_before"), "again")
    words = common.durable(words, "classes")
    classes = np.concatenate([[REST, END], 2 + np.arange(max(0, size - 2)) % (k - 2)]).astype(np.int32)[:size]  # by frequency in turn
    seen: list[float] = []
    kept, table, parts = classes, None, PARTS
    for n in range(rounds + 1):
        held = spark.sparkContext.broadcast(classes)
        now = class_table(words.mapInArrow(lambda b, held=held: _cells(b, held, k), "cell int, n long"), k)
        held.unpersist()
        if table is None or likelihood(now) >= seen[-1]:
            kept, table = classes, now
        else:
            parts *= 2
        seen.append(likelihood(table))
        if n == rounds:
            break
        state = spark.sparkContext.broadcast((kept, table))
        moves = words.mapInArrow(lambda b, state=state, part=n % parts, parts=parts: _moves(b, state, part, parts, k), "a int, class int").collect()  # at most ``size`` rows
        state.unpersist()
        classes = kept.copy()
        for a, c in moves:
            classes[a] = c
    return kept, table, seen


def _contexts(batches, frequent, classes):
    """(word, block, codes): for each word of a block that is not frequent the classes before and behind each time it occurs in training, as two bytes before * 256 + behind."""
    number, of = frequent.value.get, classes.value
    held: dict[bytes, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    tokens, block = 0, None

    def out():
        at, codes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
        offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(at, minlength=len(held)))]).astype(np.int32)
        codes = codes[np.argsort(at, kind="stable")].astype(np.uint16)
        binary = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(np.full(len(held), block)), binary], ["word", "block", "codes"])

    for b in batches:
        for n, out_of, t in zip(b.column("block").to_pylist(), b.column("held_out").to_pylist(), _texts(b.column("text")), strict=True):
            if n != block or tokens >= HELD_TOKENS or len(held) >= HELD_WORDS:
                if held:
                    yield out()
                held, parts, tokens, block = {}, [], 0, n
            words = words_of(t)
            ids = np.fromiter(map(number, words, repeat(0)), np.int64, len(words))
            rare = np.flatnonzero(ids == 0)
            local = [held.setdefault(words[i], len(held)) for i in rare.tolist()]
            if len(rare) and not out_of:
                line = np.concatenate([[END], of[ids], [END]])
                parts.append((np.array(local), line[rare] * 256 + line[rare + 2]))
                tokens += len(rare)
    if held:
        yield out()


class Gains:
    """What counts of a word add to the likelihood in each class of a table, as if the word were new."""

    SMALL = 16

    def __init__(self, table: np.ndarray):
        self.k, self.sums = len(table), (table.sum(1), table.sum(0))
        self.sides = []  # classes behind count in the word's row of the table, those before in its column
        for cells in (np.ascontiguousarray(table.T), table):
            held = entropy(cells)
            self.sides.append((cells, held, np.stack([entropy(cells + v) - held for v in range(self.SMALL)])))

    def best(self, word: np.ndarray, codes: np.ndarray, times: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences, class) of ``size`` words from rows (word, code of the classes around it, times it so occurred)."""
        k, n, value = self.k, np.bincount(word, times, size), np.zeros((size, self.k))
        for of, (cells, held, small) in zip((codes % 256, codes // 256), self.sides, strict=True):
            pair, at = np.unique(word * k + of, return_inverse=True)
            more = np.bincount(at, times).astype(np.int64)
            for first in range(0, len(pair), 20_000):
                w, c, m = pair[first : first + 20_000] // k, pair[first : first + 20_000] % k, more[first : first + 20_000]
                step = small[np.minimum(m, self.SMALL - 1), c]
                large = m >= self.SMALL
                step[large] = entropy(cells[c[large]] + m[large, None]) - held[c[large]]
                begins = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                value[w[begins]] += np.add.reduceat(step, begins)
        for total in self.sums:
            value -= entropy(total + n[:, None]) - entropy(total)
        value[:, END] = -np.inf
        return n.astype(np.int64), value.round(6).argmax(1).astype(np.int32)


def _assigned(batches, state):
    """(block, word, packed) for each block of a training word, from rows sorted by word and block.

    ``packed`` is the word's count, whether this is its first block, and its class: n * 512 + first * 256 + class.
    """
    gain, names = Gains(state.value), []
    parts: list[tuple[np.ndarray, ...]] = []  # (place in names, code, times), each pair once
    rows: list[tuple[np.ndarray, np.ndarray]] = []  # (place in names, block)

    def gather():
        word, codes, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        pair, at = np.unique(word << 16 | codes, return_inverse=True)
        parts[:] = [(pair >> 16, pair & 0xFFFF, np.bincount(at, times, len(pair)))]

    def solve(size: int):
        gather()
        word, codes, times = parts[0]
        done = word < size
        n, best = gain.best(word[done], codes[done], times[done], size)
        parts[:] = [(word[~done] - size, codes[~done], times[~done])]
        at, block = (np.concatenate(x) for x in zip(*rows, strict=True))
        cut = int(np.searchsorted(at, size))
        rows[:] = [(at[cut:] - size, block[cut:])]
        at, block = at[:cut], block[:cut]
        packed = n[at] << 9 | np.concatenate([[1], at[1:] != at[:-1]]) << 8 | best[at]
        seen = n[at] > 0
        out = pa.RecordBatch.from_arrays([pa.array(block[seen]), pa.array(names[:size], pa.binary()).take(pa.array(at[seen])), pa.array(packed[seen].astype(np.int64))], ["block", "word", "packed"])
        del names[:size]
        return out

    for b in batches:
        if not b.num_rows:
            continue
        words = b.column("word")
        new = np.concatenate([[not names or names[-1] != words[0].as_py()], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)])
        place = len(names) - 1 + np.cumsum(new)
        names += words.filter(pa.array(new)).to_pylist()
        rows.append((place, b.column("block").to_numpy()))
        lengths = pc.binary_length(b.column("codes")).to_numpy()
        codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint16).astype(np.int64)
        parts.append((np.repeat(place, lengths // 2), codes, np.ones(len(codes))))
        if len(parts) > 200:  # few words that are not yet done
            gather()
        if len(names) > 4000:
            yield solve(len(names) - 1)  # the last word may go on
    if names:
        yield solve(len(names))


_CODED = {"is_doc": pa.bool_(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "plain": pa.float64(), "emitted": pa.float64(), "classes": pa.binary()}


def _coded(batches, known):
    """Documents as classes, from rows sorted by block, its words first and then its documents.

    ``plain`` sums log10(n + 1) over tokens, ``emitted`` log10(n - discount)
    over known ones.  A row that is no document has the classes of the words
    whose first block this is.
    """
    block, own = None, {}
    for b in batches:
        if not b.num_rows:
            continue
        out: dict[str, list] = {c: [] for c in _CODED}
        blocks, docs = b.column("block").to_numpy(), b.column("packed").is_null().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (docs[1:] != docs[:-1])) + 1).tolist(), b.num_rows]
        for first, last in zip(cuts, cuts[1:], strict=False):
            rows = b.slice(first, last - first)
            if blocks[first] != block:
                block, own = blocks[first], known.value.copy()
            texts = rows.column("text").to_pylist()
            if not docs[first]:
                packed = rows.column("packed").to_numpy()
                own.update(zip(texts, (packed >> 9 << 8 | packed & 255).tolist(), strict=True))
                fresh = (packed[packed >> 8 & 1 == 1] & 255).astype(np.uint8).tobytes()
                for c, v in zip(_CODED, (False, None, 0, 0, 0.0, 0.0, fresh), strict=True):
                    out[c].append(v)
                continue
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                words = words_of(text)
                words.append(_END)
                line = np.fromiter(map(own.get, words, repeat(UNKNOWN)), np.int64, len(words))
                counts, classes = line >> 8, line & 255
                hit = counts[counts > 0]
                values = (True, doc_id, len(line), len(hit), float(np.log10(counts + 1).sum()), float(np.log10(hit - DISCOUNT).sum()), classes.astype(np.uint8).tobytes())
                for c, v in zip(_CODED, values, strict=True):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, _CODED[c]) for c, v in out.items()], list(out))


def _kinds(batches):
    """(cell, n): a task's numbers of words by class."""
    total = np.zeros(256, np.int64)
    for b in batches:
        for classes in b.column("classes").to_pylist():
            total += np.bincount(np.frombuffer(classes, np.uint8), minlength=256)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])


def _lines(column):
    """Per text its classes, the end in front."""
    for t in column.to_pylist():
        yield np.concatenate([[END], np.frombuffer(t, np.uint8)]).astype(np.int64)


def _transitions(batches, k: int):
    total = np.zeros(k * k, np.int64)
    for b in batches:
        for line in _lines(b.column("classes")):
            total += np.bincount(line[:-1] * k + line[1:], minlength=k * k)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])


def transition_probabilities(table: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """(classes + 1, classes + 1): rows are the class before, columns the class; the last of either is the unknown word.

    ``unknown`` is the probability of the unknown word in each class.  Known
    words' discounts are in their own probabilities, not here.
    """
    k = len(table)
    share = table.sum(0) / max(1.0, table.sum())
    strength = float(k)
    rows = (table + strength * share) / (table.sum(1) + strength)[:, None]
    rows = np.concatenate([rows, share[None]])
    return np.concatenate([rows, (rows @ unknown)[:, None]], axis=1)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, frequent: int = FREQUENT, fold: int = 2, folds: int = 7) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    if not 3 <= classes < UNKNOWN:
        raise ValueError(f"classes must be 3 to {UNKNOWN - 1}")
    spark = docs.sparkSession
    common.small_batches(spark, 20_000)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), common.text_or_empty(text).alias("text")).withColumn("held_out", held_out)
    rows = common.durable(rows.mapInArrow(_blocks, "doc_id long, text string, held_out boolean, block long"), "texts", compression="zstd")
    train = rows.where("not held_out").select("text")

    sent = common.durable(train.mapInArrow(lambda b: _often(b, frequent), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    tokens = sent.where("word is null").agg(F.sum("n")).first()[0] or 0
    candidates = [bytes(r.word) for r in sent.where(F.col("word").isNotNull() & (F.col("n") * (2 * frequent) >= tokens)).collect()]  # at most 2 * ``frequent`` rows
    numbers = {w: i + 2 for i, w in enumerate(sorted(candidates))}
    held = spark.sparkContext.broadcast(numbers)
    pairs = common.durable(train.mapInArrow(lambda b: _pairs(b, held), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    held.unpersist()
    counts = {r.a: r.n for r in pairs.groupBy("a").agg(F.sum("n").alias("n")).collect()}  # as many
    often = sorted((w for w in candidates if counts[numbers[w]] * frequent >= tokens), key=lambda w: (-counts[numbers[w]], w))
    renumber = np.zeros(len(numbers) + 2, np.int32)
    renumber[1] = 1
    for i, w in enumerate(often):
        renumber[numbers[w]] = i + 2
    new = spark.sparkContext.broadcast(renumber)
    pairs = common.durable(pairs.mapInArrow(lambda b: _renumbered(b, new), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    found, counted, _ = exchange(spark, pairs, len(often) + 2, classes, rounds if tokens else 0)
    of, table = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(counted)
    held = spark.sparkContext.broadcast({w: i + 2 for i, w in enumerate(often)})

    contexts = rows.select("block", "held_out", "text").mapInArrow(lambda b: _contexts(b, held, of), "word binary, block long, codes binary")
    given = contexts.repartition("word").sortWithinPartitions("word", "block").mapInArrow(lambda b: _assigned(b, table), "block long, word binary, packed long")
    given = given.select("block", "packed", F.lit(None).cast("long").alias("doc_id"), F.col("word").alias("text"))
    texts = rows.select("block", F.lit(None).cast("long").alias("packed"), "doc_id", F.encode("text", "UTF-8").alias("text"))
    frequent_words = {w: counts[numbers[w]] << 8 | int(found[i + 2]) for i, w in enumerate(often)} | ({_END: counts[1] << 8 | END} if tokens else {})
    known = spark.sparkContext.broadcast(frequent_words)
    schema = "is_doc boolean, doc_id long, n_tokens long, n_known long, plain double, emitted double, classes binary"
    coded = given.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("packed").asc_nulls_last()).mapInArrow(lambda b: _coded(b, known), schema)
    coded = common.durable(coded.withColumn("held_out", held_out), "coded")

    kinds = np.bincount([v & 255 for v in frequent_words.values()], minlength=256)
    for r in coded.where("not is_doc").select("classes").mapInArrow(_kinds, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a class
        kinds[r.cell] += r.n
    types = int(kinds.sum())
    coded = coded.where("is_doc")
    learnt = class_table(coded.where("not held_out").select("classes").mapInArrow(lambda b: _transitions(b, classes), "cell int, n long"), classes)
    mass = np.maximum(learnt.sum(0), 1)
    chances = transition_probabilities(learnt, DISCOUNT * kinds[:classes] / mass) if tokens else np.ones((classes + 1, classes + 1))
    # a known token's share of its class is taken with the step into the class
    chances[:, :classes] /= mass if tokens else 1
    final = spark.sparkContext.broadcast(np.log10(np.maximum(chances, 1e-300)))

    def score(batches):
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            base = b.column("plain").to_numpy() - n * np.log10(tokens + types + 1)
            total = []
            for line, emitted in zip(_lines(b.column("classes")), b.column("emitted").to_pylist(), strict=True):
                line = np.minimum(line, classes)
                total.append(float(final.value[line[:-1], line[1:]].sum()) + emitted)
            keep = [b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(total, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
