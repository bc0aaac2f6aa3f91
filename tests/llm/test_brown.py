"""Class bigrams against a plain version in memory that recomputes every likelihood from the tokens."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ragloom.llm import brown

SCHEMA = "doc_id long, text string, n long, block long, classes string"


def tokens_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def bigram_likelihood(pairs, of):
    cells, first, second = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        cells[of[a], of[b]] += n
        first[of[a]] += n
        second[of[b]] += n
    h = lambda c: sum(n * math.log(n) for n in c.values())
    return h(cells) - h(first) - h(second)


def brute(rows, k, rounds, frequent):
    """Rows of the result, and the classes of all words."""
    lines = [(i, tokens_of(t)) for i, t in rows]
    train = [t for i, t in lines if not held(i)]
    count = Counter(w for t in train for w in t)
    total, types = sum(count.values()), len(count)
    often = sorted((w for w in count if w != "\n" and count[w] * frequent >= total), key=lambda w: (-count[w], w.encode()))
    number = {w: i + 2 for i, w in enumerate(often)} | {"\n": 1}
    pairs = Counter((number.get(a, 0), number.get(b, 0)) for t in train for a, b in zip(["\n", *t], t, strict=False))
    of = [brown.REST, brown.END, *(2 + i % (k - 2) for i in range(len(often)))]
    best, parts, seen = of, brown.PARTS, []
    for n in range(rounds + 1):
        now = bigram_likelihood(pairs, of)
        if not seen or now >= seen[-1] - 1e-9:
            best = of
            seen.append(now)
        else:
            parts *= 2
            seen.append(seen[-1])
        if n == rounds:
            break
        of = list(best)
        for w in range(2, len(of)):
            if w * 2654435761 % (1 << 32) * parts >> 32 == n % parts:
                value = [-math.inf] + [round(bigram_likelihood(pairs, [*best[:w], c, *best[w + 1 :]]), 6) for c in range(1, k)]
                of[w] = best[w] if max(value) <= value[best[w]] else value.index(max(value))
    cells = np.zeros((k, k))
    for (a, b), n in pairs.items():
        cells[best[a], best[b]] += n
    classes = {w: best[n] for w, n in number.items()}
    around = defaultdict(Counter)
    for t in train:
        line = ["\n", *t, "\n"]
        for a, w, b in zip(line, line[1:-1], line[2:], strict=False):
            if w not in number:
                around[w][best[number.get(a, 0)], 0] += 1
                around[w][best[number.get(b, 0)], 1] += 1
    h = lambda x: x * math.log(x) if x else 0.0
    for w, c in around.items():
        value = []
        for q in range(1, k):
            v = sum(h(cells[q, x] + n) - h(cells[q, x]) if side else h(cells[x, q] + n) - h(cells[x, q]) for (x, side), n in c.items())
            value.append(round(v - sum(h(s[q] + count[w]) - h(s[q]) for s in (cells.sum(0), cells.sum(1))), 6))
        classes[w] = 1 + value.index(max(value))
    mass, kinds, moves = Counter(), Counter(), Counter()
    for w, c in classes.items():
        if w in count:
            mass[c] += count[w]
            kinds[c] += 1
    for t in train:
        moves.update((classes[a], classes[b]) for a, b in zip(["\n", *t], t, strict=False))
    off = brown.DISCOUNT
    share = {c: sum(n for (_, b), n in moves.items() if b == c) / max(1, total) for c in range(k)}
    leaving = Counter()
    for (a, _), n in moves.items():
        leaving[a] += n

    def step(a, c):
        return share[c] if a is None else (moves[a, c] + k * share[c]) / (leaving[a] + k)

    def chance(before, w):
        a = classes.get(before) if before in count else None
        if w in count:
            return step(a, classes[w]) * (count[w] - off) / mass[classes[w]]
        return sum(step(a, c) * off * kinds[c] / max(1, mass[c]) for c in range(k))

    out = []
    for i, t in lines:
        base = sum(math.log10((count[w] + 1) / (total + types + 1)) for w in t)
        score = sum(math.log10(chance(a, w)) for a, w in zip(["\n", *t], t, strict=False)) if total else 0.0
        out.append((i, held(i), len(t), sum(w in count for w in t), total, base, score))
    return out, seen, count, chance


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    groups = [["Ab", "cd", "ef", "gh"], ["1", "2", "3"], ["x" * 9, "é", "ü中"]]
    out = []
    for i in range(120):
        words = [rng.choice(groups[j % 3]) if rng.random() < 0.9 else f"w{rng.randint(0, 60)}" for j in range(rng.randint(0, 40))]
        out.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return out + [(None, "Ab 1 null"), (7, out[7][1]), (7, out[7][1]), (500, None), (501, ""), (502, " \r "), (503, "ab " * 30_000), (504, "y" * 60_000)]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-6)


def test_scores_equal_the_plain_version(spark, rows, monkeypatch):
    frame = spark.createDataFrame([(*r, 1, 2, "") for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(brown, "BLOCK", 600)  # several blocks a task
    want, seen, count, chance = brute(rows, 6, 5, 200)
    assert seen[-1] > seen[0]
    same(brown.score_texts(frame, classes=6, rounds=5, frequent=200).collect(), want)
    for before in ("\n", "ab", "1", "w3", "never seen"):
        assert sum(chance(before, w) for w in [*count, "never seen"]) == pytest.approx(1)


def test_small_pieces_give_the_same(spark, rows, monkeypatch):
    frame = spark.createDataFrame([(*r, 1, 2, "") for r in rows], SCHEMA).repartition(3)
    for name, value in (("HELD_WORDS", 5), ("HELD_TOKENS", 50)):
        monkeypatch.setattr(brown, name, value)
    same(brown.score_texts(frame, classes=5, rounds=2, frequent=50).collect(), brute(rows, 5, 2, 50)[0])


def test_nothing_to_learn_from(spark):
    assert brown.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    out = [i for i in range(100) if held(i)][:3]
    got = brown.score_texts(spark.createDataFrame([(i, "a b", 1, 1, "") for i in out], SCHEMA)).collect()
    assert [tuple(r)[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * 3


def test_gains_equal_the_likelihood():
    rng, k = np.random.default_rng(1), 4
    pairs = Counter({(int(a), int(b)): int(rng.integers(1, 9)) for a, b in rng.integers(0, 12, (60, 2))})
    of = rng.integers(0, k, 12)
    table = np.zeros((k, k))
    for (a, b), n in pairs.items():
        table[of[a], of[b]] += n
    assert brown.likelihood(table) == pytest.approx(bigram_likelihood(pairs, of))
    after, before, again = np.zeros((12, k)), np.zeros((12, k)), np.zeros(12)
    for (a, b), n in pairs.items():
        after[a, of[b]] += n
        before[b, of[a]] += n
        again[a] += n * (a == b)
    value = brown.gains(table, of, after, before, again)
    for w in range(12):
        want = [bigram_likelihood(pairs, [*of[:w], c, *of[w + 1 :]]) for c in range(k)]
        assert value[w] - value[w, 0] == pytest.approx(np.array(want) - want[0], abs=1e-5)


def test_scores_beat_single_words_on_held_out_texts(spark):
    from ragloom.llm.common import table

    got = brown.score_texts(table(spark, "/root/testdata/sf0.001", "documents")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()
