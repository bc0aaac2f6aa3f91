"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk (0), good (1) or nothing (-1).
Expectation-maximisation over the counts of vote patterns, at most
3 ** labellers rows however large the corpus, estimates each labeller's
behaviour in either class.  The posteriors label a bounded sample of different
texts, and a hashed linear scorer learns from it; it then scores every whole text.

Defined results: null and empty texts carry the vote of the ``empty`` labeller
alone; repeated rows each get their row; an empty table gives an empty result;
clashing input columns are not read.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Kept

#: Different texts that the scorer is fitted on at most, those of least hash, and its dimension.
SAMPLE, DIMENSION = 6_000, 1 << 14
_LETTER = bytes([*range(65, 91), *range(97, 123)])
_UPPER, _SYMBOL = bytes(range(65, 91)), b"%*$&#@^~<>=+{}\\"
_SHAPE = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
_NOT_ASCII, _RUN = re.compile("[^\x00-\x7f]+"), re.compile(r"(.)\1+")


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


LABELLERS = ("symbols", "shouting", "exclaims", "pipes", "repeats", "variety", "plain", "empty")
_PLAIN = bytes([*range(65, 91), *range(97, 123), *range(128, 256), *b" \n.,'-"])


def measures(text: str | None) -> tuple[list[float], list[str]]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = (text or "").split()
    n, letters = max(1, len(data)), max(1, _count(data, _LETTER))
    again = sum(map(operator.eq, words, words[1:])) / max(1, len(words) - 1)
    return [_count(data, _SYMBOL) / n, _count(data, _UPPER) / letters, data.count(b"!") / n, data.count(b"|") / n, again, len(set(words)) / max(1, len(words)), _count(data, _PLAIN) / n, len(words)], words


def votes(m: list[float]) -> list[int]:
    """One vote a labeller: 0 junk, 1 good, -1 none."""
    if not m[7]:
        return [-1] * 7 + [0]
    symbols, upper, exclaims, pipes, again, variety, plain, count = m
    pick = lambda junk, good=False: 0 if junk else 1 if good else -1
    return [
        pick(symbols > 0.05),
        pick(upper > 0.5),
        pick(exclaims > 0.03),
        pick(pipes > 0.02),
        pick(again > 0.2, again == 0 and count > 20),
        pick(variety < 0.12 and count > 60, variety > 0.3),
        pick(plain < 0.85, plain > 0.97),
        -1,
    ]


def shape(word: str) -> str:
    """A word's kinds of characters, each run of one kind once, up to eight."""
    s = word.translate(_SHAPE)
    return _RUN.sub(r"\1", s if s.isascii() else _NOT_ASCII.sub("x", s))[:8]


_SHAPES = Kept(shape)


def features(m: list[float], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, value): word shapes by share, and the measures in steps."""
    shapes = Counter(map(_SHAPES.recall().__getitem__, words))
    named = {f"shape {k}": (v / max(1, len(words))) ** 0.5 for k, v in shapes.items()}
    named |= {f"{name} {min(9, int(v * 20))}": 1.0 for name, v in zip(LABELLERS[:6], m, strict=False)}
    named |= {f"plain {min(20, int(m[6] * 20))}": 1.0, f"words {min(8, int(m[7]).bit_length())}": 1.0}
    out: dict[int, float] = {}
    for k, v in named.items():
        h = zlib.crc32(k.encode("utf-8", "surrogatepass")) % DIMENSION
        out[h] = out.get(h, 0.0) + v
    return np.fromiter(out, np.int32, len(out)), np.fromiter(out.values(), np.float32, len(out))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, behaviour[labeller, class, vote + 1], share of good).

    A labeller is a table of what it votes in each class; starts from the
    majority vote, so that class 1 is what most labellers call good.
    """
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    q = np.where(bad > 0, 0.15, np.where(good > 0, 0.9, 0.5)) if len(patterns) else np.empty(0)
    total = max(1.0, counts.sum())
    for _ in range(rounds):
        table = np.empty((patterns.shape[1], 2, 3))
        for k in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                hit = patterns[:, k] == v
                table[k, 1, v + 1] = (counts * q)[hit].sum() + 0.1
                table[k, 0, v + 1] = (counts * (1 - q))[hit].sum() + 0.1
        table /= table.sum(axis=2, keepdims=True)
        share = min(max((counts * q).sum() / total, 1e-3), 1 - 1e-3)
        at = np.arange(patterns.shape[1])
        log = [np.log(table[at, c, patterns + 1]).sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - share) / share), -50, 50)))
        if len(new) and np.abs(new - q).max() < 1e-9:
            q = new
            break
        q = new
    return q, table, share


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear scorer on soft labels: accelerated gradient steps with L2."""
    w, bias = np.zeros(DIMENSION), 0.0
    if not rows:
        return w, 0.0
    at = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    col, val = np.concatenate([c for c, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows]).astype(float)
    n, rate, moment, moment_bias = len(rows), 0.5, np.zeros(DIMENSION), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[col] * val, n) + bias, -40, 40)))
        g = (p - target) / n
        moment = 0.9 * moment - rate * (np.bincount(col, g[at] * val, DIMENSION) + 1e-5 * w)
        moment_bias = 0.9 * moment_bias - rate * g.sum()
        w, bias = w + moment, bias + moment_bias
    return w, bias


def score_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, weak (posterior of its votes), score, keep (score >= 0.5)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def code(v):
        return sum((x + 1) * 3**k for k, x in enumerate(v))

    def vote(batches):
        seen: dict[int, int] = {}
        for b in batches:
            for t in b.column("text").to_pylist():
                c = code(votes(measures(t)[0]))
                seen[c] = seen.get(c, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["pattern", "n"])

    found = rows.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3 ** labellers rows
    patterns = np.array([[r.pattern // 3**k % 3 - 1 for k in range(len(LABELLERS))] for r in found], np.int64).reshape(-1, len(LABELLERS))
    counts = np.array([r.n for r in found], float)
    posterior, _, _ = expectation_maximisation(patterns, counts)
    known = {r.pattern: float(q) for r, q in zip(found, posterior, strict=True)}

    hashed = rows.select(F.xxhash64("text").alias("h"), "text")
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last if last is not None else 0))

    def sampled(batches):
        seen = set()  # at most ``sample`` texts; repeated ones are looked at once a task
        for b in batches:
            out = []
            for h, t in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    m, w = measures(t)
                    c, v = features(m, w)
                    out.append((h, code(votes(m)), c, v))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["h", "pattern", "cols", "vals"])

    drawn = chosen.mapInArrow(sampled, "h long, pattern long, cols array<int>, vals array<float>").groupBy("h").agg(F.min(F.struct("pattern", "cols", "vals")).alias("r"))
    got = drawn.select("h", "r.*").toArrow().combine_chunks().sort_by("h")  # at most ``sample`` rows
    target = np.array([known[p] for p in got["pattern"].to_pylist()])
    weights, bias = fit([(np.asarray(c.values), np.asarray(v.values)) for c, v in zip(got["cols"], got["vals"], strict=True)], target)
    held = spark.sparkContext.broadcast((weights, bias, known))

    def score(batches):
        w, bias, weak = held.value
        for b in batches:
            p, s = [], []
            for t in b.column("text").to_pylist():
                m, words = measures(t)
                c, v = features(m, words)
                p.append(weak[code(votes(m))])
                s.append(float(1 / (1 + np.exp(-np.clip(w[c] @ v + bias, -40, 40)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array([x >= 0.5 for x in s], pa.bool_())], ["doc_id", "weak", "score", "keep"])

    return rows.mapInArrow(score, "doc_id long, weak double, score double, keep boolean")
