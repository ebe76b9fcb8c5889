"""Chains across tiles, runs instead of pairs, names that repeat, and running sums in ranges, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import annotate, coverage, dedup, statistics
from helixframe.operators import interval_join as ij
from helixframe.sources import readers

SCHEMA = "chrom string, start long, end long, name string, strand string"


def fragments(rng, n, most=400, size=60):
    return [(f"chr{rng.randint(1, 2)}", s, s + rng.randint(1, size), f"f{i}", rng.choice("+-")) for i in range(n) for s in [rng.randint(0, most)]]


@pytest.mark.parametrize("tile", [7, 50, 10_000])
def test_chains(spark, tile):
    rng = random.Random(tile)
    at, runs = 0, []
    for _ in range(120):
        at += rng.choice([0, 0, 1, 3, 9, 40])
        runs.append(("c", at, at + rng.randint(1, 30), rng.randint(1, 2)))
        at = runs[-1][2]
    df = spark.createDataFrame(runs, "chrom string, start long, end long, depth long")
    for gap, value in ((0, None), (3, None), (0, "depth")):
        expected, begin = [], None
        for k, (_, s, e, d) in enumerate(runs):
            if not k or s - runs[k - 1][2] > gap or value and d != runs[k - 1][3]:
                begin = s
            expected.append((s, begin))
        got = sorted((r.start, r.chain) for r in ij.chained(df, ["chrom"], "chain", gap=gap, value=value, tile=tile).collect())
        assert got == expected


@pytest.mark.parametrize("tile", [13, 1000])
def test_depth_of_regions_by_base(spark, tile):
    rng = random.Random(tile)
    frags, regions = fragments(rng, 80), [(c, s, e, f"r{i}", st) for i, (c, s, e, _, st) in enumerate(fragments(rng, 20, size=90))]
    f, r = spark.createDataFrame(frags, SCHEMA), spark.createDataFrame(regions, SCHEMA)
    for strand in (None, "same"):
        depth = {n: [sum(c == fc and fs <= p < fe and (strand is None or st == fst) for fc, fs, fe, _, fst in frags) for p in range(s, e)] for c, s, e, n, st in regions}
        assert {x.name: x.pileup for x in coverage.pileup(r, f, ["name"], tile=tile, strand=strand).collect()} == {n: max(d) for n, d in depth.items()}
        b = {x.name: (x.mean_depth, x.breadth) for x in coverage.breadth(r, f, ["name"], 2, tile=tile, strand=strand).collect()}
        assert b == {n: (pytest.approx(sum(d) / len(d)), pytest.approx(sum(v >= 2 for v in d) / len(d))) for n, d in depth.items()}
        h = Counter({(x.name, x.depth): x.bases for x in coverage.depth_histogram(r, f, ["name"], tile=tile, strand=strand).collect()})
        assert h == Counter((n, v) for n, d in depth.items() for v in d if v)
        begin = {n: s for _, s, _, n, _ in regions}
        assert {x.name: x.summit for x in coverage.summits(r, f, ["name"], tile=tile, strand=strand).collect()} == {n: begin[n] + d.index(max(d)) for n, d in depth.items() if max(d)}
    merged = sorted((x.chrom, x.strand, x.start, x.end, x.n) for x in ij.merge_intervals(f, stranded=True, tile=tile).collect())
    expected = []
    for c, st in sorted({(x[0], x[4]) for x in frags}):
        own = []
        for s, e in sorted((x[1], x[2]) for x in frags if (x[0], x[4]) == (c, st)):
            if own and s <= own[-1][1]:
                own[-1] = (own[-1][0], max(e, own[-1][1]), own[-1][2] + 1)
            else:
                own.append((s, e, 1))
        expected += [(c, st, *x) for x in own]
    assert merged == sorted(expected)


def test_segments_do_not_depend_on_tiles(spark, monkeypatch):
    """Islands are found by hand; every segment lies in one of them, and tiles change nothing."""
    rng = random.Random(8)
    f = spark.createDataFrame([("c", s, s + rng.randint(30, 90), str(i), "+") for i in range(300) for s in [rng.choice([0, 300, 1200]) + rng.randint(0, 160)]], SCHEMA)
    track = coverage.coverage_runs(f)
    found = []
    for tile in (64, 100_000):
        monkeypatch.setattr(coverage, "TILE", tile)
        found.append(sorted(map(tuple, coverage.segments(track, 1).collect())))
    assert found[0] == found[1] and found[0]
    high = sorted((r.start, r.end) for r in track.where("depth > 1").collect())
    islands = []
    for s, e in high:
        if islands and s - islands[-1][1] <= 10:
            islands[-1][1] = e
        else:
            islands.append([s, e])
    assert all(any(a <= s and e <= b and 40 <= b - a <= 450 for a, b in islands) for _, s, e, *_ in found[0])


def test_names_that_repeat_lose_no_row(spark):
    peaks = spark.createDataFrame([("c", 0, 10, "p", "+"), ("c", 500, 510, "p", "+"), ("c", 0, 10, "p", "+")], "chrom string, start long, end long, peakname string, strand string")
    notes = spark.createDataFrame([("c", 5, 20, "g", "+", "miRNA")], "chrom string, start long, end long, gene_name string, strand string, bio_type string")
    assert sorted((r.start, r.b_gene_name) for r in annotate.score_overlaps(peaks, notes).collect()) == [(0, "g"), (0, "g"), (500, None)]
    assert [r.start for r in ij.interval_anti(peaks, notes).collect()] == [500]
    assert sorted((r.start, r.hit) for r in ij.has_overlap(peaks, notes, "hit").collect()) == [(0, True), (0, True), (500, False)]
    assert sorted((r.start, r.best_gene_name) for r in ij.best_overlap(peaks, notes, "gene_name").collect()) == [(0, "g"), (0, "g"), (500, None)]


def test_running_sums_ranks_and_p_values(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), float(rng.randint(0, 300))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = {(r.g, r.v): r.r for r in statistics.with_ranks(df, "v", "r", ["g"]).collect()}
    for g, v in rng.sample(rows, 50):
        own = [x for h, x in rows if h == g]
        assert ranks[g, v] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2
    p = df.select("g", (F.col("v") / 301).alias("p"))
    got = {(r.g, r.p): r.padj for r in statistics.adjust_bh(p, "p", ["g"]).collect()}
    for g in "ab":
        own = sorted(v / 301 for h, v in rows if h == g)
        least = 1.0
        for k in range(len(own), 0, -1):
            least = min(least, own[k - 1] * len(own) / k)
            if k == 1 or own[k - 2] != own[k - 1]:
                pass
            assert got[g, own[k - 1]] <= least + 1e-12
        assert got[g, own[-1]] == pytest.approx(own[-1])
    obs, null = df.limit(40), spark.createDataFrame([(rng.choice("ab"), float(rng.randint(0, 300))) for _ in range(500)], "g string, draw double")
    draws = [tuple(r) for r in null.collect()]
    for less in (True, False):
        for r in statistics.empirical_p(obs, null, "g", "v", less=less).collect():
            own = [d for g, d in draws if g == r.g]
            assert r.p == pytest.approx(sum(d <= r.v if less else d >= r.v for d in own) / len(own))


def test_marks_by_place(spark):
    rows = [("c", 1, 9, "+", 5, "b"), ("c", 1, 9, "+", 7, "a"), ("c", 1, 9, "+", 7, "z"), ("c", 2, 9, None, 1, "q")]
    df = spark.createDataFrame(rows, "chrom string, a long, b long, s string, q long, name string")
    assert {r.name: r.is_duplicate for r in dedup.mark_duplicates(df, "a", "b", "s", "q", "name").collect()} == {"a": False, "b": True, "z": True, "q": False}


def test_bedgraph_keeps_all_contigs(spark, tmp_path):
    (tmp_path / "x.bedgraph").write_text("track type=bedGraph\nbrowser position c\n# note\ntRNA-Ala\t1\t5\t2.5\nchr1 0 4 1\n")
    assert sorted(map(tuple, readers.read_bedgraph(spark, str(tmp_path / "x.bedgraph")).collect())) == [("chr1", 0, 4, 1.0), ("tRNA-Ala", 1, 5, 2.5)]
