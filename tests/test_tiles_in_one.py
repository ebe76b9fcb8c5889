"""What is counted for a region in one tile, against brute force, and plans without a join of pairs."""

import random
from collections import Counter, defaultdict

import pytest

from helixframe.operators import counting, coverage, tiles
from helixframe.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(autouse=True, params=[16, 5_000])
def tile(request, monkeypatch):
    for f in (tiles.by_tiles, tiles.in_one_tile):
        monkeypatch.setattr(f, "__defaults__", (request.param,))


def meet(p, q):
    return p[0] == q[0] and max(p[1], q[1]) < min(p[2], q[2]) and p[1] < p[2] and q[1] < q[2]


def trna(s, e, size, n):
    half = size // 2
    if s < 5 and e >= size - 5:
        return "Full-length tRNA"
    if s < 5 and half - 1 <= e <= half + 4:
        return "5' half"
    if e >= size - 5 and half - 3 <= s <= half + 2:
        return "3' half"
    if s < 5 and n < 23:
        return "tRF-5"
    return "tRF-3" if e >= size - 5 and n < 23 else "Others"


@pytest.mark.parametrize("barcodes", [3, 25])
def test_trna_barcodes(spark, sf_dir, barcodes):
    rng = random.Random(barcodes)
    f = [(rng.choice("cd"), s, s + rng.choice([0, 3, rng.randint(1, 60), rng.randint(18, 26)]), rng.choice(["+", "-", None]), rng.choice([None, *[f"u{i}" for i in range(barcodes)]])) for _ in range(500) for s in [rng.randint(-20, 400)]]
    g = [(rng.choice("cd"), s, s + rng.choice([0, rng.randint(1, 30), rng.randint(20, 90), 300]), rng.choice(["+", "-", None]), f"g{i if rng.random() < 0.8 else 0}") for i in range(120) for s in [rng.randint(-20, 400)]]
    place = "chrom string, start long, end long, strand string"
    expected = defaultdict(set)
    for p in f:
        for q in g:
            if meet(p, q) and p[3] == q[3] and q[3]:
                expected[q[4], trna(p[1] - q[1], p[2] - q[1], q[2] - q[1], p[2] - p[1])].update({p[4]} - {None})
    found = counting.trna_barcodes(spark.createDataFrame(f, place + ", umi string"), spark.createDataFrame(g, place + ", gene string"), "gene", "umi")
    assert {(r.gene, r["class"]): r.n for r in found.collect()} == {k: len(v) for k, v in expected.items()}
    assert " Join " not in plan(registry.QUERIES["cnt4_trna_fragments"](spark, sf_dir))


def places(rng, n, size):
    return [(rng.choice("cd"), s, s + rng.randint(0, size), f"n{i if rng.random() < 0.8 else 0}", rng.choice(["+", "-", None])) for i in range(n) for s in [rng.randint(-20, 400)]]


PLACE = "chrom string, start long, end long, name string, strand string"


def test_orientations(spark, sf_dir):
    rng = random.Random(2)
    f, g = places(rng, 300, 60), places(rng, 90, 70)
    expected = {}
    for q in g:
        hits = [p[4] for p in f if meet(p, q) and p[2] - p[1] < 1.1 * (q[2] - q[1])]
        if hits:
            sense, anti = expected.get(q[3], (0, 0))
            expected[q[3]] = sense + sum(x is not None and x == q[4] for x in hits), anti + sum(None not in (x, q[4]) and x != q[4] for x in hits)
    found = counting.orientations(spark.createDataFrame(f, PLACE), spark.createDataFrame(g, PLACE), "name", 1.1)
    assert {r.name: (r.sense, r.antisense) for r in found.collect()} == expected
    assert " Join " not in plan(registry.QUERIES["cnt6_orientation"](spark, sf_dir))


@pytest.mark.parametrize(("size", "width"), [(6, 16), (60, 5_000), (400, 64)])
def test_positions(spark, sf_dir, size, width):
    rng = random.Random(size)
    f, g = places(rng, 700, size), places(rng, 60, 70)
    expected = Counter((p[1] - q[1], p[2] - q[1]) for p in f for q in g if meet(p, q))
    found = counting.positions(spark.createDataFrame(f, PLACE), spark.createDataFrame(g, PLACE), width)
    assert {(r.s, r.e): r.n for r in found.collect()} == expected
    assert " Join " not in plan(registry.QUERIES["cnt8_positions"](spark, sf_dir))


@pytest.mark.parametrize("strand", [None, "same"])
def test_depth_of_regions(spark, sf_dir, strand):
    rng = random.Random(7)
    f, g = places(rng, 200, 40), places(rng, 90, 50)
    x, y = spark.createDataFrame(f, PLACE), spark.createDataFrame(g, PLACE)
    tops, bases = Counter(), Counter()
    for q in g:
        hits = [p for p in f if meet(p, q) and (not strand or p[4] == q[4] and q[4])]
        depth = [sum(p[1] <= i < p[2] for p in hits) for i in range(q[1], q[2])]
        tops[q[3], max(depth, default=0)] += 1
        bases.update((q, d) for d in depth if d)
    assert Counter((r.name, r.pileup) for r in coverage.pileup(y, x, ["name"], strand=strand, tile=32).collect()) == tops
    found = Counter({((r.chrom, r.start, r.end, r["name"], r.strand), r.depth): r.bases for r in coverage.depth_histogram(y, x, ["chrom", "start", "end", "name", "strand"], strand=strand).collect()})
    assert found == bases
    assert " Join " not in plan(registry.QUERIES["ag13_depth_histogram"](spark, sf_dir))


def test_samples_of_regions(spark):
    rng = random.Random(8)
    f, g = places(rng, 120, 30), places(rng, 90, 50)
    f = [(*p[:4], rng.choice(["a", "b", "c", None])) for p in f]
    expected = {}
    for q in g:
        hits = {p[4] for p in f if meet(p, q)}
        if hits:
            expected[q[:4]] = len(hits - {None})
    found = coverage.distinct_covering(spark.createDataFrame(g, PLACE), spark.createDataFrame(f, PLACE), ["chrom", "start", "end", "name"], "strand", tile=50)
    assert {(r.chrom, r.start, r.end, r["name"]): r.strand_count for r in found.collect()} == expected
    assert "b_strand" not in plan(found)
