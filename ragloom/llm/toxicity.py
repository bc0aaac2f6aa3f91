"""Toxicity: a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their leading letters, hashed;
a text's length changes nothing else.  The loss is the log loss over labelled
texts plus ``FAIR`` times the squared change of the score when identity terms
are swapped: each training text is paired with a copy in which the group terms
it mentions are exchanged for other groups' (a text that mentions none gets a
neutral mention of one group, and of another in the copy).  An L1 proximal
step keeps weights of words that tell nothing at zero.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows of the
folds given (a bounded, documented sample: the ids of least hash that have a
document, each with one text); scoring reads every whole text where it lies,
without a shuffle.

Defined results: null and empty texts get the score of no feature; null labels
are not learnt from; a null doc_id is not held out; where there is nothing to learn from, every score is under
1e-17; an empty table gives an empty result;
repeated rows each get their row; clashing columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

SAMPLE, DIMENSION, ROUNDS = 10_000, 1 << 20, 120
FAIR, SPARSE = 1.0, 2e-4
PREFIXES = (4, 5, 6, 7)
#: Identity terms by language; a swap exchanges a term for another of its row.
IDENTITY = (
    ("women", "men"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SWAP = {t: row for row in IDENTITY for t in row}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIMENSION for f in ("=" + word, *(word[:n] for n in PREFIXES if len(word) >= n))]


def text_features(words: set[str], known: dict | None = None) -> np.ndarray:
    known = {} if known is None else known
    out: set[int] = set()
    for w in words:
        f = known.get(w)
        if f is None:
            f = known[w] = word_features(w)
        out.update(f)
    return np.fromiter(sorted(out), np.int32, len(out))


def swaps(named: list[str], seed: int) -> tuple[list[str], list[str], list[str]]:
    """Identity words (that the text has, of its copy, of the other copy).

    A text that names groups is set against itself with other groups named; a
    text that names none gets a neutral mention of one group, and of another.
    """
    held = sorted(named)
    first = held or [IDENTITY[seed % len(IDENTITY)][0]]
    change = [_SWAP[w][(_SWAP[w].index(w) + 1 + seed % (len(_SWAP[w]) - 1)) % len(_SWAP[w])] for w in first]
    return held, first, change


class Rows:
    """A sparse matrix; entries are 1, or what ``value`` gives."""

    def __init__(self, rows: list[np.ndarray], value: np.ndarray | None = None):
        self.n = len(rows)
        self.at = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.value = np.ones(len(self.col)) if value is None else value

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.col] * self.value, self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, g[self.at] * self.value, size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(features: list[np.ndarray], named: list[list[str]], labels: np.ndarray, rounds: int = ROUNDS, fair: float = FAIR, sparse: float = SPARSE) -> tuple[dict[int, float], float]:
    """Non-zero weights by feature and the bias; accelerated proximal gradient steps, deterministic.

    Features whose share of toxic texts is what chance gives (|z| < 2) are
    left out before, but for those of identity terms.
    """
    if not len(labels):
        return {}, -40.0
    n, labels = len(labels), np.asarray(labels, float)
    seen, toxic = np.zeros(DIMENSION), np.zeros(DIMENSION)
    for r, y in zip(features, labels, strict=True):  # row by row: the whole matrix would fill the driver
        seen[r] += 1
        toxic[r] += y
    share = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    z = (toxic - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    kept = (seen >= 3) & (np.abs(z) >= 2)
    kept[[f for t in _SWAP for f in word_features(t)]] = True
    used = np.flatnonzero(kept)
    place = np.full(DIMENSION, -1)
    place[used] = np.arange(len(used))
    d = len(used)
    x = Rows([(p := place[r])[p >= 0] for r in features])
    copies: list[tuple[list, list]] = [([], []), ([], [])]
    for i, (r, held) in enumerate(zip(features, named, strict=True)):
        has, one, two = swaps(held, i)
        gone = {f for w in has for f in word_features(w)}
        rest = set(r.tolist()) - gone
        for k, terms in enumerate((one, two)):
            new = {f for w in terms for f in word_features(w)}
            plus, minus = sorted(new - gone - rest), sorted(gone - new)
            copies[k][0].append(place[np.array(plus + minus, np.int64)])
            copies[k][1].extend([1.0] * len(plus) + [-1.0] * len(minus))
    each = [Rows(rows, np.array(value)) for rows, value in copies]
    support = np.bincount(x.col, minlength=d)
    scale = 1 / np.sqrt(np.maximum(support, 1) / n + 1e-3)  # rare and frequent features move alike
    weight = np.where(labels > 0, n / (2 * max(1, labels.sum())), n / (2 * max(1, (labels == 0).sum())))
    w, bias = np.zeros(d), 0.0
    ahead, ahead_bias, t, rate = w.copy(), bias, 1.0, 0.02
    for _ in range(rounds):
        at = x.dot(ahead) + ahead_bias
        g = weight * (_sigmoid(at) - labels) / n
        a, b = (_sigmoid(at + m.dot(ahead)) for m in each)
        h = 2 * fair * (a - b) / n
        ha, hb = h * a * (1 - a), h * b * (1 - b)
        grad = x.back(g + ha - hb, d) + each[0].back(ha, d) - each[1].back(hb, d)
        step = rate * scale
        moved = ahead - step * scale * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * sparse * scale, 0)
        new_bias = ahead_bias - 0.5 * (g + ha - hb).sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    keep = np.flatnonzero(w)
    return {int(used[i]): float(w[i]) for i in keep}, float(bias)


class Scorer:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple] = {}

    def _word(self, word: str) -> tuple:
        if len(self.known) > 300_000:
            self.known.clear()
        found = tuple(f for f in word_features(word) if f in self.weights)
        self.known[word] = found
        return found

    def __call__(self, text: str | None) -> float:
        known, hit = self.known, set()
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                f = self._word(w)
            if f:
                hit.update(f)
        z = self.bias + sum(self.weights[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Fit on the rows of ``labels`` (doc_id, toxic) outside the held-out fold, found in ``docs``."""
    spark = docs.sparkSession
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("toxic is not null and doc_id is not null and " + "pmod(crc32(cast(doc_id as string)), 5) <> 0")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    use = use.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    use = use.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the draw is the same at every run
    chosen = rows.join(use, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # repeated ids are learnt from once
    common.small_batches(spark)

    def run(batches):
        known: dict = {}
        for b in batches:
            known.clear()
            found = [words_of(t) for t in b.column("text").to_pylist()]
            features = pa.array([text_features(w, known) for w in found], pa.list_(pa.int32()))
            named = pa.array([sorted(w for w in ws if w in _SWAP) for ws in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), features, named], ["doc_id", "toxic", "features", "named"])

    rows = chosen.mapInArrow(run, "doc_id long, toxic double, features array<int>, named array<string>").toArrow()  # ``sample`` rows at most
    rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    return Scorer(*fit([np.asarray(v.values) for v in rows["features"]], rows["named"].to_pylist(), rows["toxic"].to_numpy() > 0))


def _with(docs: DataFrame, name: str) -> StructType:
    return StructType([*docs.schema.fields]).add(name, "double")


def _scored(docs: DataFrame, scorer: Scorer, text: str, name: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))  # bounded by DIMENSION

    def run(batches):
        score = Scorer(*held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([score(t) for t in b.column(text).to_pylist()], pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, _with(docs, name))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scorer = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = _scored(rows, scorer, "text", "score")
    return scored.select("doc_id", F.expr("coalesce(pmod(crc32(cast(doc_id as string)), 5) = 0, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` scored under ``threshold``."""
    name = common.fresh(docs, "toxic_score")
    return _scored(docs, train(docs, labels, sample), "text", name).where(F.col(name) < threshold).drop(name)
