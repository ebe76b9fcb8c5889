"""What made queries fail on larger tables: frames, hidden broadcasts, pairs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from helixframe.operators import counting
from helixframe.operators import interval_join as ij
from helixframe.plans import registry
from helixframe.plans.fixtures import fixture


def plan(df):
    return df._jdf.queryExecution().toString()


def test_chains_have_no_frame_that_is_read_anew_for_each_row(spark):
    rng = random.Random(3)
    starts = sorted(rng.sample(range(3000), 400))
    runs = [("c", s, min(s + 4, e)) for s, e in zip(starts, [*starts[1:], 4000])]
    for tile in (50, 10_000):
        got = ij.chained(spark.createDataFrame(runs, "chrom string, start long, end long"), ["chrom"], "first", gap=2, tile=tile, end="till")
        assert "unboundedfollowing" not in plan(got).lower()
        expected = []
        for _, s, e in runs:
            if expected and s - expected[-1][-1][1] <= 2:
                expected[-1].append((s, e))
            else:
                expected.append([(s, e)])
        assert sorted((r.start, r.end, r["first"], r.till) for r in got.collect()) == [(s, e, c[0][0], c[-1][1]) for c in expected for s, e in c]


PLACE = "chrom string, start long, end long, name string, strand string"


def places(rng, n, size):
    return [(rng.choice("cd"), s, s + rng.randint(0, size), f"n{rng.randint(0, n)}", rng.choice(["+", "-", None])) for _ in range(n) for s in [rng.randint(0, 3000)]]


def test_bins_are_not_broadcast(spark):
    a = spark.createDataFrame([("c", 0, 10, "x", "+")], PLACE)
    for df in (ij.interval_join(a, a), ij.interval_semi(a, a), ij.interval_left(a, a), ij.has_overlap(a, a, "hit")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_best_of_pairs_and_counts_by_brute_force(spark):
    rng = random.Random(5)
    a, b = places(rng, 60, 120), places(rng, 80, 400)
    x, y = spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE)
    meet = lambda p, q: p[0] == q[0] and max(p[1], q[1]) < min(p[2], q[2]) and p[1] < p[2] and q[1] < q[2]
    assert Counter((r.start, r.end, r.name, r.least) for r in ij.has_overlap(x, y, "least", label="name").collect()) == Counter((p[1], p[2], p[3], min((q[3] for q in b if meet(p, q)), default=None)) for p in a)
    assert Counter((r.start, r.end, r.n) for r in counting.interval_counts(x, y, "n").collect()) == Counter((p[1], p[2], sum(meet(p, q) for q in b)) for p in a)
    best = lambda p: min(((-(min(p[2], q[2]) - max(p[1], q[1])), q[3]) for q in b if meet(p, q)), default=(0, None))[1]
    assert Counter((r.start, r.end, r.best_name) for r in ij.best_overlap(x, y, "name").collect()) == Counter((p[1], p[2], best(p)) for p in a)
    sense = anti = 0
    for p in a:
        refs = [q[4] for q in b if meet(p, q)]
        sense += sum(s is None or s == p[4] for s in refs) if refs else 1
        anti += sum(s is None or (p[4] is not None and s != p[4]) for s in refs) if refs else 1
    assert [(r.sense, r.antisense) for r in counting.strand_counts(x.withColumn("s", F.lit("s")), y, "s").collect()] == [(sense, anti)]
    starts = {}
    for p in {p for p in a if p[4]}:
        met = Counter(q[1] for q in b if meet(p, q) and q[4] == p[4])
        if met:
            starts[p] = max(met.values()) / sum(met.values())
    assert {(r.chrom, r.start, r.end, r["name"], r.strand): r.flush for r in counting.flush_ends(x, y, "name").collect()} == starts


def test_rows_of_one_name_are_one_fragment_if_wanted(spark):
    f = spark.createDataFrame([("c", 0, 10, "f", "+"), ("d", 0, 10, "f", "+")], PLACE)
    g = spark.createDataFrame([("c", 5, 15, "x", "+", "G1"), ("d", 0, 10, "x", "+", "G2")], PLACE + ", gene_id string")
    assert [(r.name, r.gene_id, r.score) for r in counting.best_assignment(f, g, by="name").collect()] == [("f", "G2", 1.0)]


def test_quality_rounds_as_the_sql_does(spark, tmp_path):
    row = "1L AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, 1 AS l_linenumber, 'F' AS l_linestatus"
    spark.sql(f"SELECT {row}, explode(array(0.5D, 1.5D, 1.4D, 2.6D)) AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(r.quality for r in fixture(spark, str(tmp_path), "dedup").collect()) == [0, 1, 2, 3]


def test_exon_filter_broadcasts_nothing(spark, sf_dir):
    assert "Broadcast" not in registry.QUERIES["cov5_exon_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
