"""Statistics against values known from tables or worked out by hand."""

import pytest
from pyspark.sql import functions as F

from helixframe.functions import rules, statistics as fs
from helixframe.operators import counting, statistics


def test_beta_and_normal_tails(spark):
    assert fs.beta_cdf_value(2, 3, 0.5) == pytest.approx(0.6875)
    assert fs.beta_cdf_value(1, 1, 0.3) == pytest.approx(0.3)
    assert fs.beta_cdf_value(50, 50, 0.5) == pytest.approx(0.5)
    assert (fs.beta_cdf_value(2, 3, 0), fs.beta_cdf_value(2, 3, 1)) == (0, 1)
    df = spark.createDataFrame([(1.959964, 2.0, 3.0), (0.0, 1.0, 1.0)], "z double, a double, b double")
    got = df.select(fs.normal_sf("z"), fs.log_beta("a", "b")).collect()
    assert got[0][0] == pytest.approx(0.025, abs=1e-6) and got[0][1] == pytest.approx(-2.4849066, abs=1e-6)
    assert got[1][0] == 0.5 and got[1][1] == 0


def test_adjusted_p_values_with_ties(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.02), ("d", 0.5), ("e", 1.0)], "id string, p double")
    got = {r.id: r.padj for r in statistics.adjust_bh(df.withColumn("g", F.lit(1)), "p", ["g"]).collect()}
    assert got["b"] == got["c"] == pytest.approx(0.02 * 5 / 3)
    assert got["a"] == pytest.approx(0.02 * 5 / 3) and got["d"] == pytest.approx(0.625) and got["e"] == 1


def test_quantile_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 4, 5)], "v double")
    got = sorted((r.v, r.bin) for r in statistics.quantile_bins(df, "v", 2).collect())
    assert got == [(1.0, 0), (2.0, 0), (2.0, 0), (3.0, 1), (4.0, 1), (5.0, 1)]


def test_rank_sum_and_empirical_p(spark):
    df = spark.createDataFrame([("g", s, v) for s, vs in (("x", (1, 2, 3)), ("y", (4, 5, 6))) for v in vs], "g string, s string, v long")
    r = statistics.rank_sum(df, "v", "s", "x", ["g"]).first()
    assert r.z == pytest.approx(-1.963961) and r.p == pytest.approx(0.0495, abs=1e-3)
    obs = spark.createDataFrame([("k", 2.0)], "k string, v double")
    null = spark.createDataFrame([("k", x) for x in (1.0, 2.0, 3.0, 4.0)], "k string, draw double")
    assert statistics.empirical_p(obs, null, "k", "v").first().p == 0.5
    assert statistics.empirical_p(obs, null, "k", "v", less=False).first().p == 0.75


def test_difference_of_distributions(spark):
    x = spark.createDataFrame([(0, 0.5), (20, 0.5)], "value long, p double")
    y = spark.createDataFrame([(0, 0.25), (9, 0.25), (30, 0.5)], "value long, p double")
    r = statistics.difference_over(x, y, 10).first()
    assert r.p == pytest.approx(0.25) and r.odds == pytest.approx(1 / 3)


def test_rules_first_match_and_fold(spark):
    df = spark.createDataFrame([("Mt_tRNA",), ("protein_coding",), (None,)], "t string")
    assert [r[0] for r in df.select(rules.classify(F.col("t"), rules.RNA_TYPE_RULES)).collect()] == ["tRNA", "Protein coding", "other"]
    m = spark.createDataFrame([("AAC", "+", 3), ("GTT", "-", 4), ("CCC", "+", 1)], "m string, s string, n long")
    got = sorted(tuple(r) for r in counting.fold_strands(m, "m", "s", "n", F.reverse(F.translate("m", "ACGT", "TGCA"))).collect())
    assert got == [("AAC", "+", 7), ("CCC", "+", 1), ("GTT", "-", 7)]
