"""Sums over pairs by tiles, against brute force, and plans without a join of pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from helixframe.operators import counting, tiles
from helixframe.plans import registry

PLACE = "chrom string, start long, end long, name string, strand string"


def places(rng, n, size, most=600):
    return [(rng.choice("cd"), s, s + rng.randint(0, size), f"n{i if rng.random() < 0.8 else 0}", rng.choice(["+", "-", None])) for i in range(n) for s in [rng.randint(0, most)]]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(autouse=True, params=[64, 5_000])
def tile(request, monkeypatch):
    monkeypatch.setattr(tiles.by_tiles, "__defaults__", (request.param,))


def meet(p, q):
    return p[0] == q[0] and max(p[1], q[1]) < min(p[2], q[2]) and p[1] < p[2] and q[1] < q[2]


def test_dominated():
    rng = np.random.default_rng(1)
    x, y, w = rng.integers(0, 40, (3, 200))
    a, b = rng.integers(-5, 45, (2, 90))
    assert tiles.dominated(x, y, w, a, b).tolist() == [int(w[(x < i) & (y < j)].sum()) for i, j in zip(a, b)]
    assert tiles.dominated(x[:0], y[:0], w[:0], a[:2], b[:2]).tolist() == [0, 0]


def test_labels_at_points(spark, sf_dir):
    rng = random.Random(1)
    peaks, points = places(rng, 150, 90), [(f"g{rng.randint(0, 12)}", rng.choice("cd"), rng.randint(0, 600)) for _ in range(60)]
    peaks = [(c, s, e, n if n != "n7" else None, st) for c, s, e, n, st in peaks]
    found = counting.labels_at_points(spark.createDataFrame(points, "name string, chrom string, pos long"), spark.createDataFrame(peaks, PLACE).withColumnRenamed("name", "label"), "name", "label")
    expected = {}
    for g in {p[0] for p in points}:
        hits = [(p[2], q[3]) for p in points if p[0] == g for q in peaks if q[0] == p[1] and q[1] <= p[2] < q[2]]
        if hits:
            expected[g] = (len({h[0] for h in hits}), len({h[1] for h in hits if h[1] is not None}))
    assert {r.name: (r.points, r["labels"]) for r in found.collect()} == expected
    assert "FlatMapCoGroupsInArrow" in plan(registry.QUERIES["cnt17_junctions_in_peaks"](spark, sf_dir))


def test_terminal_classes(spark, sf_dir):
    rng = random.Random(2)
    f, g = places(rng, 300, 60), places(rng, 80, 150)
    expected = Counter()
    for p in f:
        for q in g:
            if meet(p, q) and p[1] >= q[1] and p[2] <= q[2]:
                five, three = p[1] - q[1] < 5, q[2] - p[2] < 5
                expected["full" if five and three else "5 end" if five else "3 end" if three else "internal", p[2] - p[1] < 45] += 1
    found = counting.terminal_classes(spark.createDataFrame(f, PLACE), spark.createDataFrame(g, PLACE))
    assert {(r["class"], r.short): r.n for r in found.collect()} == expected
    assert " Join " not in plan(registry.QUERIES["cnt7_terminal_classes"](spark, sf_dir))


def test_full_length(spark, sf_dir):
    rng = random.Random(3)
    f, g = places(rng, 600, 9, 90), places(rng, 80, 9, 90)
    found = counting.full_length(spark.createDataFrame(f, PLACE), spark.createDataFrame(g, PLACE), "name")
    expected = {}
    for q in set(g):
        hits = [abs(p[1] - q[1]) < 5 and abs(p[2] - q[2]) < 5 for p in f if meet(p, q) and p[4] == q[4] and q[4]]
        if hits:
            expected[q] = sum(hits)
    assert {(r.chrom, r.start, r.end, r["name"], r.strand): r.full_length for r in found.collect()} == expected
    assert "FlatMapCoGroupsInArrow" in plan(registry.QUERIES["ag9_full_length"](spark, sf_dir))
