"""Values of queries without SQL, done again in plain Python."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import annotate, composite, coverage, counting
from helixframe.operators import interval_join as ij
from helixframe.plans import registry


def test_subsample_keeps_whole_pairs_and_its_share(spark, sf_dir):
    fragments = registry.fixture(spark, sf_dir, "fragments")
    of = {}
    for r in fragments.select("name").collect():
        of.setdefault(r.name.split("_")[1], set()).add(r.name)
    got = {}
    for r in registry.QUERIES["flt16_subsample"](spark, sf_dir).collect():
        got.setdefault(r.read, set()).add(r.name)
    assert all(got[k] == of[k] for k in got) and 0.05 < len(got) / len(of) < 0.15
    again = composite.subsample(fragments.repartition(7).withColumn("read", F.split_part("name", F.lit("_"), F.lit(2))), "read", 0.1, seed=42)
    assert {r.read for r in again.select("read").collect()} == set(got)


def test_components_and_loadings(spark, sf_dir):
    types = ["protein_coding", "miRNA", "tRNA", "Simple_repeat", "lncRNA"]
    wide = counting.pivot(registry.fixture(spark, sf_dir, "counts"), ["samplename"], "gene_type", types, F.sum("read_count")).collect()
    x = np.log1p(np.array([[r[t] for t in types] for r in wide], float))
    _, vectors = np.linalg.eigh(np.cov(x.T))
    vectors = vectors[:, ::-1][:, :2]
    vectors *= np.sign(vectors[abs(vectors).argmax(axis=0), [0, 1]])
    load = {r.column: (r.pc1, r.pc2) for r in registry.QUERIES["st12_loadings"](spark, sf_dir).collect()}
    assert np.allclose([load[t] for t in types], vectors, atol=1e-5)
    scores = {r.samplename: (r.pc1, r.pc2) for r in registry.QUERIES["st12_components"](spark, sf_dir).collect()}
    assert np.allclose([scores[r.samplename] for r in wide], x @ vectors, atol=1e-4)


def test_second_pass_lies_in_what_the_first_left(spark, sf_dir):
    rows = registry.QUERIES["cov7_two_passes"](spark, sf_dir).collect()
    first = sorted(tuple(r)[:3] for r in rows if r.call == 1)
    assert first == sorted(tuple(r)[:3] for r in registry.QUERIES["cov6_segments"](spark, sf_dir).collect()) and first
    track = coverage.coverage_runs(registry.fixture(spark, sf_dir, "fragments"), tile=10_000)
    rest = ij.interval_anti(track, spark.createDataFrame(first, "chrom string, start long, end long"))
    assert sorted(tuple(r)[:3] for r in rows if r.call == 2) == sorted(tuple(r)[:3] for r in coverage.segments(rest, 1).collect())


def called(depth):
    """The rule of segments over one island-free track of single bases, in plain Python: (start, end, top)."""
    high = [p for p, d in enumerate(depth) if d > 1]
    islands = []
    for p in high:
        if islands and p - islands[-1][1] <= 10:
            islands[-1][1] = p + 1
        else:
            islands.append([p, p + 1])
    out = []
    for s, e in islands:
        if not 40 <= e - s <= 450:
            continue
        own = [d if d > 1 else 0 for d in depth[s:e]]
        median = float(np.median(own))
        pieces, p = [], s
        while p < e:
            q = p
            while q < e and depth[q] > 1 and depth[q] >= median:
                q += 1
            if q > p:
                pieces.append((sum(v - median for v in depth[p:q]), -p, q))
            p = max(q, p + 1)
        if e - s <= 150:
            pieces = [x for x in [max(pieces, key=lambda x: x[:2])] if x[2] + x[1] > 5]
        else:
            pieces = [x for x in pieces if 50 < x[2] + x[1] < 150]
        out += [(-m, q, max(depth[-m:q])) for _, m, q in pieces]
    return sorted(out)


def test_segments_by_the_rule_base_by_base(spark):
    rng = np.random.default_rng(4)
    steps = [(int(rng.integers(1, 60)), int(rng.choice([0, 0, 1, 2, 3, 5, 6, 9]))) for _ in range(900)] + [(20, 0), (20, 2), (60, 6), (20, 2), (30, 0), (100, 4), (49, 9), (30, 0), (100, 4), (51, 9), (30, 1), (150, 3), (30, 0), (151, 3), (30, 0), (200, 2), (149, 5), (90, 2)]
    depth, runs = [], []
    for n, d in steps:
        if d:
            runs.append(("c", len(depth), len(depth) + n, d))
        depth += [d] * n
    track = spark.createDataFrame(runs, "chrom string, start long, end long, depth long")
    expected = called(depth)
    assert len(expected) > 20
    for tile in (37, 100_000):
        got = coverage.segments(track, 1, tile=tile).collect()
        assert sorted((r.start, r.end, r.top) for r in got) == expected
        assert all(r.center == (r.start + r.end) / 2 for r in got)


def test_best_stretch_by_brute_force(spark):
    rng = np.random.default_rng(6)
    rows, expected = [], {}
    for g in range(12):
        gains, at = rng.integers(-4, 5, int(rng.integers(1, 30))), 0
        own = []
        for v in gains:
            n = int(rng.integers(1, 9))
            own.append((g, at, at + n, float(v)))
            at += n
        rows += own
        expected[g] = max((sum(x[3] for x in own[i:j]), -own[i][1], own[j - 1][2]) for i in range(len(own)) for j in range(i + 1, len(own) + 1))
    df = spark.createDataFrame(rows, "g int, start long, end long, gain double")
    for tile in (5, 17, 1000):
        assert {r.g: (r.gain, -r.start, r.end) for r in coverage.best_stretch(df, ["g"], tile).collect()} == expected


def test_exon_filter_and_supplementary_table(spark, sf_dir):
    rows = registry.QUERIES["ann7_supplementary"](spark, sf_dir).collect()
    assert rows and all(r.pileup >= 2 and not (r.exonic and r.sense_gtype == "protein_coding") for r in rows)
    fc = {r.peakname: r.fc for r in registry.fixture(spark, sf_dir, "peaks").collect()}
    assert all(fc[r.peakname] > 10 and r.label == ("Sense" if r.sense_gname != "." else "Antisense" if r.antisense_gname != "." else "Unannotated") for r in rows)
    assert [(r.chrom, r.start, r.peakname) for r in rows] == sorted((r.chrom, r.start, r.peakname) for r in rows)


def test_projection_swaps_ends(spark):
    exons = spark.createDataFrame([("t", "c", 100, 110, "+"), ("t", "c", 200, 220, "+"), ("m", "c", 100, 110, "-"), ("m", "c", 200, 220, "-")], "name string, chrom string, start long, end long, strand string")
    x = spark.createDataFrame([("t", 5, 15, "a"), ("m", 5, 25, "b"), ("m", 0, 31, "beyond")], "name string, start long, end long, id string")
    assert sorted((r.id, r.start, r.end) for r in ij.project(x, exons).collect()) == [("a", 106, 205), ("b", 105, 214)]


def test_genic_classes_reach_every_branch(spark):
    peak = "chrom string, start long, end long, peakname string, psi double"
    rows = [("full", 1000, 1100, 0.0), ("within", 1010, 1030, 0.05), ("between", 1010, 1030, 0.15), ("run", 960, 1070, 0.5), ("exon", 910, 990, 0.0), ("mostly", 920, 1015, 0.0), ("pseudo", 5000, 5050, 0.0), ("none", 9000, 9010, 0.0)]
    peaks = spark.createDataFrame([("c", s, e, n, p) for n, s, e, p in rows], peak)
    parts = spark.createDataFrame([("c", 1000, 1100, "intron"), ("c", 900, 1000, "exon"), ("c", 5000, 5100, "transcribed_pseudogene")], "chrom string, start long, end long, gtype string")
    got = {r.peakname: r["class"] for r in annotate.genic_classes(peaks, parts, parts.where("gtype = 'intron'").select("chrom", "start", "end")).collect()}
    assert got == {"full": "Full-length intron", "within": "Within intron", "between": "intron", "run": "Exon", "exon": "Exon", "mostly": "Exon", "pseudo": "Pseudogene", "none": "."}
    run = spark.createDataFrame([("c", 955, 1041, "on", 0.5)], peak)
    exon = spark.createDataFrame([("c", 960, 1000, "exon")], "chrom string, start long, end long, gtype string")
    assert annotate.genic_classes(run, exon, parts.where("gtype = 'intron'").select("chrom", "start", "end")).first()["class"] == "Exon-intron"
