"""Joins whose result is all pairs: against brute force over mixed lengths, and that a's rows are not copied on the way."""

import random

import pytest

from helixframe.operators import interval_join as ij
from helixframe.plans import registry

SCHEMA = "chrom string, start long, end long, name string, strand string"


def rows(rng, n, sizes, at=2000):
    return [(rng.choice(["c", "d", None]), s, s + rng.choice(sizes), f"n{i}", rng.choice(["+", "-", ".", None])) for i in range(n) for s in [rng.randint(-at, at)]]


@pytest.mark.parametrize("width", [1, 64])
@pytest.mark.parametrize("a_sizes, b_sizes", [([0, 1, 7, 30], [1, 4, 300]), ([3, 900, 20_000], [2, 60, 5_000]), ([1, 9], [3, 40_000])])
@pytest.mark.parametrize("strand, frac", [(None, 0.0), ("same", 0.0), ("opposite", 0.25)])
def test_pairs_by_brute_force(spark, width, a_sizes, b_sizes, strand, frac):
    rng = random.Random(width + len(a_sizes))
    a, b = rows(rng, 60, a_sizes) + [("c", None, 4, "null", "+"), ("c", 9, 3, "turned", "+")], rows(rng, 60, b_sizes) + [("c", 3, 3, "empty", "+")]
    expected = []
    for c, s, e, n, st in a:
        for bc, bs, be, bn, bst in b:
            if s is None or None in (c, bc) or c != bc or e <= s or be <= bs or not (s < be and bs < e) or min(e, be) - max(s, bs) < frac * (e - s):
                continue
            if strand and (None in (st, bst) or (st == bst) != (strand == "same")):
                continue
            expected.append((n, bn, min(e, be) - max(s, bs)))
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    flags = {"width": width, "strand": strand, "frac_a": frac}
    got = [(r.name, r.b_name, r.overlap) for r in ij.pairs(x, y, **flags).collect()]
    assert sorted(got) == sorted(expected) and expected
    left = [(r.name, r.b_name or "", r.overlap) for r in ij.interval_left(x, y, **flags).collect()]
    assert sorted(left) == sorted(expected + [(n, "", 0) for n in {r[3] for r in a} - {p[0] for p in expected}])


@pytest.mark.parametrize("name", ["flt8_relative_size", "jn1_inner", "jn2_left", "jn4_fractions", "jn5_same_strand", "jn5_opposite_strand"])
def test_only_one_side_is_spread(spark, sf_dir, name):
    """The larger side goes to its bins without a Generate, and one join makes all rows."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join, *more = [i for i, line in enumerate(plan) if "Join " in line]
    first = next(i for i, line in enumerate(plan) if "Relation " in line)
    assert not more and not any("Generate" in line for line in plan[join:first])
