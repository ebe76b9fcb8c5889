"""Hooks for a caller's functions of groups and rows: nulls, empty groups and tables."""

from helixframe.operators import composite


def test_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), (None, 2), ("b", None)], "g string, v long")
    got = composite.per_group(df, ["g"], lambda key, rows: rows.assign(w=rows["v"].astype(float) * 2)[lambda d: d["w"] > 2], "v long, w double")
    assert sorted((r.g or "", r.v, r.w) for r in got.collect()) == [("", 2, 4.0), ("a", 5, 10.0)]
    assert composite.per_group(df.where("FALSE"), ["g"], lambda key, rows: rows, "v long").count() == 0


def test_generators(spark):
    df = spark.createDataFrame([("a", 3, 1.5), ("b", 0, None), (None, 1, 2.5)], "k string, n long, x double")
    got = composite.expand(df, ["n"], lambda n: ((i, str(i)) for i in range(n)), "i long, s string", ["k", "x"])
    assert sorted((r.k or "", r.x, r.i, r.s) for r in got.collect()) == [("", 2.5, 0, "0"), ("a", 1.5, 0, "0"), ("a", 1.5, 1, "1"), ("a", 1.5, 2, "2")]


def test_whole_groups_across_batches(spark):
    rows = [(None if k == 0 else f"g{k}", k % 2, i) for k in range(9) for i in range((k * 7) % 11 + 1)]
    df = spark.createDataFrame(rows, "g string, h int, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = composite.whole_groups(df, ["g", "h"], lambda d: d.groupby(["g", "h"], dropna=False)["v"].agg(n="count", total="sum").reset_index(), "n long, total long").collect()
        few = composite.score_sequences(spark.createDataFrame([("AC",), (None,), ("GGGGG",), ("",)], "seq string"), lambda s: s.str.len() + 0.0 * len(s), batch=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for g, h, v in rows:
        n, t = expected.get((g, h), (0, 0))
        expected[g, h] = (n + 1, t + v)
    assert {(r.g, r.h): (r.n, r.total) for r in got} == expected and len(got) == len(expected)
    assert composite.whole_groups(df.where("FALSE"), ["g"], lambda d: d, "v long").count() == 0
    assert sorted((r.seq or "", r.score) for r in few if r.seq is not None) == [("", 0.0), ("AC", 2.0), ("GGGGG", 5.0)]


def test_scores_come_in_batches_of_bounded_bytes(spark):
    df = spark.createDataFrame([("G" * 1000,)] * 50, "seq string").coalesce(1)
    got = composite.score_sequences(df, lambda s: s.str.len() * 0.0 + s.str.len().sum(), batch=5000)
    assert max(r.score for r in got.collect()) <= 6000


def test_small_groups_are_not_one_call_each(spark, sf_dir):
    from helixframe.plans import registry

    assert "FlatMapGroupsInArrow" not in registry.QUERIES["udf2_top_samples"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_beyond_all_intervals_are_not_joined(spark):
    chunks = spark.createDataFrame([("c", i, "ACGT") for i in range(100)], "chrom string, chunk long, seq string")
    spots = spark.createDataFrame([("x", "c", 6, 13, "+"), ("y", "c", 9, 10, "-")], "name string, chrom string, start long, end long, strand string")
    found = composite.interval_sequences(spots, chunks, size=4)
    assert {r["name"]: r.seq for r in found.collect()} == {"x": "GTACGTA", "y": "G"}
    assert "<= 3" in found._jdf.queryExecution().optimizedPlan().toString()
    assert composite.interval_sequences(spots.where("FALSE"), chunks, size=4).count() == 0
