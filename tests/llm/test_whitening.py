"""Whitening against numpy's own eigenvalues, exact sums in plain Python, and odd tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import whitening
from helixframe.llm.common import table


def symmetric(rng, n, values=None):
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    return q @ np.diag(rng.standard_normal(n) if values is None else values) @ q.T


@pytest.mark.parametrize("seed", range(6))
def test_inertia_counts(seed):
    rng = np.random.default_rng(seed)
    a = symmetric(rng, 3 + 5 * seed)
    a = (a + a.T) / 2
    w = np.linalg.eigvalsh(a)
    assert whitening.inertia(a) == ((w > 0).sum(), (w < 0).sum(), 0)
    assert whitening.inertia(np.array([[0.0, 2, 0], [2, 0, 0], [0, 0, 0]])) == (1, 1, 1)


@pytest.mark.parametrize("values", [[9, 5, 2, 1, 0.5], [4, 4, 4, 1, 1], [7, 7 - 1e-9, 3, 3 - 1e-7, 0], [1e-8, 1e-9, 0, 0, 0], [5, 1, 1, 1, 1], [3, 3, 3, 3, 3]])
def test_leading_components(values):
    v = symmetric(np.random.default_rng(3), 5, values)
    v = (v + v.T) / 2
    e, c = whitening.leading(v, 4)
    w = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose(e, w[:4], rtol=1e-12, atol=1e-14 * w[0])
    assert np.allclose(c.T @ c, np.eye(4), atol=1e-12)
    assert np.abs(v @ c - c * e).max() < 1e-12 * w[0]


def entries(v):
    return [math.floor(256 * x) for x in v]


def by_hand(rows, k=4):
    """The whole contract in fractions and numpy, for vectors of one length."""
    own = [(i, entries(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    distinct = sorted(set(tuple(x) for _, x in own))
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[j] for x in distinct) for j in range(d)]
    v = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in distinct), n**3)) for j in range(d)] for i in range(d)])
    w, c = np.linalg.eigh(v)
    order = np.argsort(-w)[:k]
    out = {}
    for i, x in own:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        z = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ c[:, order] / np.sqrt(w[order])
        out.setdefault(i, []).append((dev, z))
    return n, out, w[order] / w.sum(), c[:, order]


def random_rows(seed, many=60, d=6):
    rng = random.Random(seed)
    scale = [3.0, 2.0, 1.5, 1.0, 0.5, 0.2][:d]
    rows = [(i, [rng.gauss(0.1, s) for s in scale]) for i in range(many)]
    return rows + rows[:20] * 3 + [(200 + i, rows[0][1]) for i in range(40)]  # repeated rows, and copies under other ids


def compare(got, rows):
    n, want, explained, _ = by_hand(rows)
    assert len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in got:
        dev, z = want[r.vec_id][0]
        assert r.n == n and r.deviation == dev
        assert abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-9
        s = signs.setdefault(r.component, 1.0 if abs(r.whitened - z[r.component - 1]) < abs(r.whitened + z[r.component - 1]) else -1.0)
        assert abs(s * r.whitened - z[r.component - 1]) < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    rows = random_rows(seed)
    odd = [(500, None), (501, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [1.0, -math.inf, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("size", "x", "n", "i", "total", "component")})
    compare(whitening.whiten(df).collect(), rows)


def test_large_entries(spark):
    rows = [(i, [x * 1000 for x in v]) for i, v in random_rows(9, 30)]
    compare(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)
    huge = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 1.0]), (None, [2.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect() if r.vec_id == 1} == {None}


def test_lengths_and_flat_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (4, None)], schema)).count() == 0  # no variance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)] + [(50 + i, [float(i % 3)]) for i in range(9)], schema)
    got = whitening.whiten(line).collect()
    assert {(r.component, r.n) for r in got if r.vec_id < 50} == {(1, 9)} and {(r.component, r.n) for r in got if r.vec_id >= 50} == {(1, 3)}
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)


def test_whole_table(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    compare(whitening.whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])
