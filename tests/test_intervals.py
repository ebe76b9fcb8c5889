"""Edge cases of interval operators, worked out by hand, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import coverage, dedup
from helixframe.operators import interval_join as ij

SCHEMA = "chrom string, start long, end long, name string, strand string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def sides(spark):
    a = make(spark, [("chr1", 10, 20, "a1", "+"), ("chr1", 20, 30, "a2", "-"), ("chr1", 0, 5000, "a3", "+"), ("chr2", 5, 6, "a4", "."), ("chrX", 1, 9, "a5", "+"), ("chr1", 7, 7, "empty", "+")])
    b = make(spark, [("chr1", 20, 25, "b1", "+"), ("chr1", 12, 14, "b2", "+"), ("chr1", 4999, 900000, "b3", "-"), ("chr2", 0, 100, "b4", "+"), ("chr3", 0, 100, "b5", "+")])
    return a, b


PAIRS = {("a1", "b2"), ("a2", "b1"), ("a3", "b1"), ("a3", "b2"), ("a3", "b3"), ("a4", "b4")}


@pytest.mark.parametrize("width", [3, 7, 100, 5000])
def test_pairs_do_not_depend_on_bins(sides, width):
    a, b = sides
    found = [(r.name, r.b_name) for r in ij.interval_join(a, b, width=width).collect()]
    assert len(found) == len(set(found)) and set(found) == PAIRS


def test_left_semi_anti_and_strands(sides):
    a, b = sides
    left = ij.interval_left(a, b).collect()
    assert sorted(r.name for r in left if r.overlap == 0) == ["a5", "empty"]
    assert {r.name for r in ij.interval_semi(a, b).collect()} == {x for x, _ in PAIRS}
    assert {r.name for r in ij.interval_anti(a, [b.where("name = 'b1'"), b.where("name = 'b4'")]).collect()} == {"a1", "a5", "empty"}
    assert {(r.name, r.b_name) for r in ij.interval_join(a, b, strand="same").collect()} == {("a1", "b2"), ("a3", "b1"), ("a3", "b2")}
    assert {(r.name, r.b_name) for r in ij.interval_join(a, b, strand="opposite").collect()} == {("a2", "b1"), ("a3", "b3"), ("a4", "b4")}


def test_fraction_at_the_limit(spark):
    a, b = make(spark, [("chr1", 0, 10, "a", "+")]), make(spark, [("chr1", 8, 30, "b", "+"), ("chr1", 9, 30, "c", "+")])
    assert [r.b_name for r in ij.interval_join(a, b, frac_a=0.2).collect()] == ["b"]


def test_merge_chains_and_bookends(spark):
    rows = [("chr1", 0, 10, "a", "+"), ("chr1", 10, 20, "b", "-"), ("chr1", 15, 40, "c", "+"), ("chr1", 41, 50, "d", "+")]
    df = make(spark, rows)
    for tile in (7, 1000):
        got = sorted((r.start, r.end, r.n) for r in ij.merge_intervals(df, tile=tile).collect())
        assert got == [(0, 40, 3), (41, 50, 1)]
    assert sorted((r.strand, r.start, r.end) for r in ij.merge_intervals(df, stranded=True).collect()) == [("+", 0, 10), ("+", 15, 40), ("+", 41, 50), ("-", 10, 20)]


def test_coverage_keeps_bases_and_fills_gaps(spark):
    rng = random.Random(3)
    rows = [("chr1", s, s + rng.randint(1, 60), str(i), "+") for i in range(200) for s in [rng.randint(0, 900)]]
    sizes = spark.createDataFrame([("chr1", 1000), ("chr9", 50)], "chrom string, size long")
    runs = coverage.coverage_runs(make(spark, rows), sizes, tile=64).collect()
    assert sum((r.end - r.start) * r.depth for r in runs) == sum(e - s for _, s, e, _, _ in rows)
    one = sorted((r.start, r.end, r.depth) for r in runs if r.chrom == "chr1")
    assert one[0][0] == 0 and all(x[1] == y[0] and x[2] != y[2] for x, y in zip(one, one[1:]))
    assert [(r.start, r.end, r.depth) for r in runs if r.chrom == "chr9"] == [(0, 50, 0)]


def test_protection_by_brute_force(spark):
    rng = random.Random(5)
    frags = [("chr1", s, s + rng.randint(10, 40), str(i), "+") for i in range(60) for s in [rng.randint(0, 300)]]
    regions = [("chr1", 50, 150, "r1", "+"), ("chr1", 200, 260, "r2", "+")]
    got = {r.name: r.protected for r in coverage.protection(make(spark, regions), make(spark, frags), ["name"]).collect()}
    for _, s, e, name, _ in regions:
        score = {p: 0 for p in range(s, e + 10)}
        for _, fs, fe, _, _ in frags:
            for p in score:
                score[p] += (fs <= p < fe) - (fs - 5 <= p < fs) - (fe <= p < fe + 5)
        top = max(score.values())
        assert got[name] == pytest.approx(sum(v > 0.8 * top for v in score.values()) / (e - s))


def test_umi_chains(spark):
    rows = [("chr1", 0, 10, "+", u) for u in ("AAAA", "AAAT", "AATT", "GGGG", "AAAA")]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, strand string, umi string")
    got = {r.cluster: (r.members, r.copies) for r in dedup.dedup_clustered(df).collect()}
    assert got == {"AAAA": (3, 4), "GGGG": (1, 1)}
    n = spark.range(1).select(dedup.poisson_umi(F.lit(16), 2).alias("full"), dedup.poisson_umi(F.lit(1), 2).alias("one")).first()
    assert n.full > 15 and n.one == pytest.approx(1.0326, abs=1e-3)
