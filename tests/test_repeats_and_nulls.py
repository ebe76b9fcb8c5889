"""Names and rows that repeat, null groups, rows in one bin and across edges, counts by prefix sums."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import annotate, counting, coverage, statistics
from helixframe.operators import interval_join as ij

PLACE = "chrom string, start long, end long, name string, strand string"


def places(rng, n, most=5000, size=900):
    return [(rng.choice(["a", "b", None]) if rng.random() < 0.1 else "a", s, s + rng.randint(0, size), f"n{rng.randint(0, n // 2)}", rng.choice("+-.")) for _ in range(n) for s in [rng.randint(0, most)]]


@pytest.mark.parametrize("long", [False, True])
@pytest.mark.parametrize("width", [50, 1000])
def test_outer_join_by_brute_force(spark, long, width):
    rng = random.Random(width + long)
    a = places(rng, 120, size=120)
    a += a[:30]  # rows that repeat
    b = places(rng, 25, size=300) + ([("a", 0, 90_000, "long", "+")] if long else [])
    x, y = spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE)
    for flags in ({}, {"strand": "same"}, {"frac_a": 0.5}):
        expected = Counter()
        for c, s, e, n, st in a:
            hits = [(bn, min(e, be) - max(s, bs)) for bc, bs, be, bn, bst in b if c is not None and bc == c and s < be and bs < e and s < e and bs < be]
            hits = [(bn, o) for (bn, o), (_, bs, be, _, bst) in zip(hits, [v for v in b if c is not None and v[0] == c and s < v[2] and v[1] < e and s < e and v[1] < v[2]]) if (not flags.get("strand") or bst == st) and o >= flags.get("frac_a", 0) * (e - s)]
            expected.update((c, s, e, n, st, bn, o) for bn, o in hits or [(None, 0)])
        got = Counter(tuple(r) for r in ij.interval_left(x, y, width=width, **flags).select("chrom", "start", "end", "name", "strand", "b_name", "overlap").collect())
        assert got == expected


def test_best_feature_of_fragments_of_one_name(spark):
    f = spark.createDataFrame([("chr1", 0, 10, "f", "+"), ("chr2", 0, 10, "f", "+"), ("chr1", 0, 10, "f", "+"), ("chr3", 0, 10, "f", "+")], PLACE)
    g = spark.createDataFrame([("chr1", 0, 10, "x", "+", "G1"), ("chr2", 5, 15, "x", "+", "G2"), ("chr2", 5, 15, "x", "+", "G3")], PLACE + ", gene_id string")
    assert sorted((r.chrom, r.gene_id, r.score) for r in counting.best_assignment(f, g).collect()) == [("chr1", "G1", 1.0), ("chr1", "G1", 1.0), ("chr2", "G2", 0.25)]


def test_peaks_of_one_name_keep_their_own_annotation(spark):
    peak = "chrom string, start long, end long, peakname string, strand string"
    p = spark.createDataFrame([("chr1", 0, 100, "p", "+"), ("chr2", 0, 100, "p", "+"), ("chr2", 0, 100, "p", "+")], peak)
    a = spark.createDataFrame([("chr1", 10, 60, "n1", "+", "tRNA")], "chrom string, start long, end long, gene_name string, strand string, bio_type string")
    out = annotate.sense_antisense(p, annotate.resolve(annotate.score_overlaps(p, a)))
    assert sorted((r.chrom, r.sense_gname, r.sense_gtype) for r in out.collect()) == [("chr1", "n1", "tRNA"), ("chr2", ".", "."), ("chr2", ".", ".")]
    f = spark.createDataFrame([("chr1", 5, 9, str(i), "+") for i in range(3)], PLACE)
    assert sorted((r.pileup) for r in coverage.pileup(p, f, ["peakname"]).collect()) == [0, 0, 3]
    assert sorted(r.mean_depth for r in coverage.breadth(p, f, ["peakname"], 1).collect()) == [0.0, 0.0, 0.12]
    assert sorted(r.protected for r in coverage.protection(p, f, ["peakname"]).collect()) == [0.0, 0.0, 0.04]
    track = spark.createDataFrame([("chr2", 0, 50, 2.0)], "chrom string, start long, end long, value double")
    assert sorted(r.mean_signal for r in coverage.mean_signal(p, track, ["peakname"]).collect()) == [0.0, 1.0, 1.0]
    assert sorted((r.chrom, r.reads) for r in counting.region_counts(p, f, "peakname").collect()) == [("chr1", 3), ("chr2", 0), ("chr2", 0)]


@pytest.mark.parametrize("tile", [7, 100, 50_000])
def test_counts_of_regions_by_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(counting, "TILE", tile)
    monkeypatch.setattr(counting.counts_below, "__defaults__", (tile,))
    rng = random.Random(tile)
    regions, frags = places(rng, 60, 600, 80), places(rng, 300, 600, 60)
    regions += regions[:9]
    r, f = spark.createDataFrame(regions, PLACE), spark.createDataFrame(frags, PLACE)
    over = lambda x, y: x[0] is not None and x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]
    expected = Counter((*x, sum(over(x, y) for y in frags), sum(over(x, y) and x[4] == y[4] for y in frags)) for x in regions)
    # a null chromosome is a chromosome of its own for no one
    got = Counter(tuple(v) for v in counting.region_counts(r, f, "name").select("chrom", "start", "end", "name", "strand", "reads", "stranded").collect())
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in expected.items() if k[0] is not None}
    points = f.select("chrom", F.col("start").alias("pos"))
    spots = {(y[0], y[1]) for y in frags}
    got = Counter(tuple(v) for v in counting.points_inside(r, points, "name").where("chrom IS NOT NULL").select("chrom", "start", "end", "name", "points").collect())
    assert got == Counter((*x[:4], sum(c == x[0] and x[1] <= p < x[2] for c, p in spots)) for x in regions if x[0] is not None)


def test_null_groups(spark):
    df = spark.createDataFrame([(None, 0.01), (None, 0.04), ("a", 0.5), ("a", None)], "g string, p double")
    assert sorted((r.g or "", r.padj) for r in statistics.adjust_bh(df, "p", ["g"]).where("p IS NOT NULL").collect()) == [("", 0.02), ("", 0.04), ("a", 0.5)]
    assert sorted((r.g or "", r.k) for r in statistics.with_ranks(df, "p", "k", ["g"]).where("p IS NOT NULL").collect()) == [("", 1.0), ("", 2.0), ("a", 1.0)]
    assert statistics.with_ranks(df, "p", "k", ["g"]).where("p IS NULL").first().k is None


def test_projection_keeps_repeated_rows(spark):
    exons = spark.createDataFrame([("t", "c", 100, 110, "+"), ("t", "c", 200, 220, "+")], "name string, chrom string, start long, end long, strand string")
    x = spark.createDataFrame([("t", 5, 15, "a"), ("t", 5, 15, "a"), ("t", 5, 15, "b")], "name string, start long, end long, id string")
    assert sorted((r.id, r.start, r.end) for r in ij.project(x, exons).collect()) == [("a", 106, 205), ("a", 106, 205), ("b", 106, 205)]


def test_saturation_by_brute_force(spark):
    rng = random.Random(2)
    counts = [rng.choice([0, 1, 2, 3, 5, 7, 10, 11, 100, 333, 12345]) for _ in range(80)]
    got = {(r.fraction, r.cutoff): r.genes for r in counting.saturation(spark.createDataFrame([(c,) for c in counts], "n long"), "n", 50).collect()}
    assert got == {(i / 50, c): sum(i / 50 * v > c for v in counts) for i in range(1, 51) for c in (1, 5, 10)}
