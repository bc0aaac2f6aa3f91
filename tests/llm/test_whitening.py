"""Whitening against a plain NumPy version, with exact integers in Python."""

import numpy as np
import pytest

from ragloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n int, x string"


def brute(rows, components=4):
    """{vec_id: (n, deviation, whitened up to sign, explained)} of rows (vec_id, vector) of one length."""
    x = {i: tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, np.float64) - np.array(sums) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in x.items():
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), np.abs((np.array(v) - np.array(sums) / n) @ vectors / np.sqrt(values)), values / np.trace(cov))
    return out


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 7)) * np.array([9, 5, 3, 2, 1, 0.5, 0.1]) + 40
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[5].tolist()) for i in range(200)]  # repeated vectors count once
    data = [(i, v, 1, 3, "clash") for i, v in rows]
    odd = [(5000, None, 1, 1, ""), (5001, [1.0, None] + [0.0] * 5, 1, 1, ""), (5002, [float("nan")] * 7, 1, 1, ""), (5003, [float("inf")] * 7, None, 1, ""), (5004, [], 1, 1, ""), (5005, [3e38] * 7, 1, 1, "")]
    out = whitening.whiten(spark.createDataFrame(data + odd, SCHEMA).repartition(7)).collect()
    want = brute(rows)
    assert len(out) == 4 * len(rows) and {r.vec_id for r in out} == set(want)
    signs = {}
    for r in out:
        n, deviation, white, explained = want[r.vec_id]
        assert (r.n, r.deviation, r.deviation_exact) == (n, deviation, deviation)
        assert abs(r.whitened) == pytest.approx(white[r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
        signs.setdefault(r.component, set()).add(np.sign(r.whitened))
    assert all(len(s - {0.0}) == 2 for s in signs.values())
    white = np.array([r.whitened for r in sorted((r for r in out if r.vec_id < 1000), key=lambda r: (r.vec_id, r.component))]).reshape(-1, 4)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-9


def test_whitening_without_variance(spark):
    rows = [(1, [1.0, 2.0], 1, 1, ""), (None, [1.0, 2.0], 1, 1, ""), (1, [1.0, 2.0], 1, 1, "")]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out} == {(1, 0, None, 0.0, None)}
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    # a constant entry: one component with a variance, one without
    out = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0], 1, 1, "") for i in range(4)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in out)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whitening_of_lengths_and_large_entries(spark):
    rows = [(i, [float(i), float(i * i)], 0, 0, "") for i in range(5)] + [(100 + i, [float(i * 1e10), float(-i), 2.0 * i * i], 0, 0, "") for i in range(6)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    two, three = brute([(r[0], r[1]) for r in rows[:5]], 2), brute([(r[0], r[1]) for r in rows[5:]], 3)
    assert len(out) == 5 * 2 + 6 * 3
    for r in out:
        n, deviation, _, explained = (two | three)[r.vec_id]
        assert (r.n, int(r.deviation_exact)) == (n, deviation)
        assert r.deviation == (deviation if deviation < 1 << 63 else None)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-6, abs=1e-12)
    assert any(r.deviation is None for r in out)
