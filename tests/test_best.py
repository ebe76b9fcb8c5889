"""The best feature of each row without pairs, against brute force, and that no pair is joined."""

import random
from collections import Counter

import numpy as np
import pytest

from helixframe.operators import annotate, best, counting
from helixframe.plans import registry


@pytest.mark.parametrize("sizes, most, digits", [([1, 3, 8], 60, 9), ([2, 5, 40, 41, 300], 400, 9), ([4, 9, 16], 30, 2), ([700, 1000], 3000, 1)])
@pytest.mark.parametrize("cells", [5, 4_000_000])
def test_best_by_brute_force(monkeypatch, sizes, most, digits, cells):
    monkeypatch.setattr(best, "CELLS", cells)
    rng = random.Random(most + digits)
    value = best.rounded(digits, counting._shares)
    for n in (1, 2, 7, 90):
        a = np.array([rng.randint(-20, most) for _ in range(n)])
        b = a + np.array([rng.choice(sizes) for _ in range(n)])
        s = np.array([rng.randint(-20, most) for _ in range(200)])
        e = s + np.array([rng.choice([1, 4, 9, 50, 900]) for _ in range(200)])
        worth, at = best.Features(a, b).best(s, e, value)
        top, rows, i, j = best.Features(a, b).windows(s, e, value)
        found = best.Features(a, b)
        for k in range(len(s)):
            shared = np.minimum(e[k], b) - np.maximum(s[k], a)
            each = np.where(shared > 0, value(shared, e[k] - s[k], b - a), -1)
            assert worth[k] == top[k] == each.max() and at[k] == (np.argmax(each) if each.max() >= 0 else -1)
            own = [x for w in np.flatnonzero(rows == k) for x in found.rank[i[w] : j[w]]]
            assert sorted(own) == (np.flatnonzero(each == each.max()).tolist() if each.max() >= 0 else [])


@pytest.mark.parametrize("strand", [None, "same"])
def test_best_assignment_by_brute_force(spark, strand):
    rng = random.Random(3)
    rows = lambda n, sizes, most: [(rng.choice(["c", "d", None]), s, s + rng.choice(sizes), f"n{rng.randint(0, n // 2)}", rng.choice(["+", "-", None])) for _ in range(n) for s in [rng.randint(-most, most)]]
    f, g = rows(300, [0, 1, 9, 30, 5000, 60_000], 9000), rows(200, [0, 2, 8, 32, 4000, 90_000], 9000)
    expected = {}
    for c, s, e, n, st in f:
        for bc, bs, be, bn, bst in g:
            over = min(e, be) - max(s, bs)
            if c is None or c != bc or over <= 0 or e <= s or be <= bs or (strand and (st is None or st != bst)):
                continue
            found = (-np.floor(over / (e - s) * over / (be - bs) * 1e9 + 0.5), bn)
            expected[n] = min(expected.get(n, found), found)
    x = spark.createDataFrame(f, "chrom string, start long, end long, name string, strand string")
    y = spark.createDataFrame(g, "chrom string, start long, end long, gene_id string, strand string")
    got = counting.best_assignment(x, y, by="name", **({"strand": strand} if strand else {}))
    assert {r.name: r.gene_id for r in got.collect()} == {n: v[1] for n, v in expected.items()}


@pytest.mark.parametrize("name", ["cnt1_best_assignment", "cnt2_gene_counts", "ann5_genic_class", "ann5_genic_classes"])
def test_no_pair_is_joined(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # before rows stream past features, introns are made of an exon and the next one
    assert "Join " not in plan[: plan.index("MapInArrow")] and plan.count("Join ") == (2 if name == "ann5_genic_classes" else 0)


def test_genic_classes_by_brute_force(spark):
    rng = random.Random(11)
    rows = lambda n, sizes, *more: [(rng.choice(["c", "d", None]), s, s + rng.choice(sizes), *[f() for f in more]) for _ in range(n) for s in [rng.randint(0, 700)]]
    peaks = rows(600, [0, 12, 40, 90], lambda: rng.choice([None, 0.05, 0.15, 0.5]))
    parts = rows(120, [0, 20, 50, 100, 101], lambda: rng.choice(["exon", "intron", "pseudo_x", "other"]))
    introns = rows(150, [0, 20, 60, 200])
    expected = []
    for c, s, e, psi in peaks:
        found = []
        for pc, ps, pe, t in parts:
            over = min(e, pe) - max(s, ps)
            if c is not None and c == pc and over > 0:
                found.append((-round(over / (e - s) * (over / (pe - ps)), 12), t, ps, pe, over / (e - s)))
        if not found:
            expected.append((c, s, e, psi, "."))
            continue
        score, t, ps, pe, share = min(found)
        into = [(x, y) for ic, x, y in introns if ic == c and min(e, y) - max(s, x) > 10]
        on = share <= 0.6 and any((abs(x - pe) < 3 and y > e) or (abs(y - ps) < 3 and x < s) for x, y in into)
        told = "Exon-intron" if on else "Exon"
        intron = "Full-length intron" if -score > 0.8 else "intron" if psi is None or 0.1 <= psi <= 0.2 else "Within intron" if psi < 0.1 else told
        expected.append((c, s, e, psi, {"intron": intron, "exon": told, "pseudo_x": "Pseudogene"}.get(t, t)))
    place = "chrom string, start long, end long"
    got = annotate.genic_classes(spark.createDataFrame(peaks, f"{place}, psi double"), spark.createDataFrame(parts, f"{place}, gtype string"), spark.createDataFrame(introns, place))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert {x[-1] for x in expected} >= {".", "Exon", "Exon-intron", "Pseudogene", "intron", "Within intron", "Full-length intron"}


def test_largest_parts_by_brute_force(spark):
    rng = random.Random(5)
    rows = lambda n, sizes, *more: [(rng.choice(["c", "d", None]), s, s + rng.choice(sizes), *[f() for f in more]) for _ in range(n) for s in [rng.randint(0, 900)]]
    peaks, parts = rows(500, [0, 12, 40, 2000]), rows(150, [0, 20, 50, 100, 3000], lambda: rng.choice(["exon", "intron"]))
    expected = []
    for c, s, e in peaks:
        found = [(-min(e, pe) + max(s, ps), t, ps, pe) for pc, ps, pe, t in parts if c is not None and c == pc and s < pe and ps < e and s < e and ps < pe]
        if found:
            over, *part = min(found)
            expected.append((c, s, e, *part, -over))
    place = "chrom string, start long, end long"
    got = annotate.largest_parts(spark.createDataFrame(peaks, place), spark.createDataFrame(parts, f"{place}, part string"))
    assert sorted(map(tuple, got.collect())) == sorted(expected) and expected


@pytest.mark.parametrize("keep", [True, False])
def test_gene_counts_by_brute_force(spark, keep):
    rng = random.Random(7)
    rows = lambda n, sizes, *more: [(rng.choice(["c", "d", None]), s, s + rng.choice(sizes), rng.choice(["+", "-", None]), *[f() for f in more]) for _ in range(n) for s in [rng.randint(-9000, 9000)]]
    f = rows(400, [0, 1, 90, 4000], lambda: rng.choice(["s1", "s2", None])) + [(None, None, 3, "+", "s1"), ("c", None, 3, "+", "s1")]
    g = rows(60, [0, 3, 700, 9000], lambda: rng.choice(["g1", "g2", None]), lambda: rng.choice(["x", None]), lambda: "t")
    expected = Counter()
    for c, s, e, st, sample in f:
        met = [(n, t, b, bst) for bc, bs, be, bst, n, t, b in g if None not in (c, s) and c == bc and s < be and bs < e and s < e and bs < be]
        for n, t, b, bst in met or ([(None, None, None, None)] if keep else []):
            for o in ("sense", "antisense"):
                if bst is None or (st is not None and (st == bst) == (o == "sense")):
                    expected[sample, o, n or ".", t or ".", b or "No features"] += 1
    x = spark.createDataFrame(f, "chrom string, start long, end long, strand string, sample string")
    y = spark.createDataFrame(g, "chrom string, start long, end long, strand string, gene_id string, gene_name string, bio_type string")
    got = {tuple(r)[:5]: r.read_count for r in counting.gene_counts(x, y, keep).select("sample", "orientation", "gene_id", "gene_name", "bio_type", "read_count").collect()}
    assert got == dict(expected) and expected


def test_sides_are_those_of_all_pairs(spark):
    rng = random.Random(13)
    strand, kind = lambda: rng.choice(["+", "-", None]), lambda: rng.choice(["miRNA", "RBP", "RBP", "Simple_repeat", "lncRNA", "other", "else", None])
    peaks = [(f"p{i}", rng.choice(["c", "d", None]), s, s + rng.choice([0, 20, 40]), strand()) for i in range(500) for s in [rng.randint(0, 600)]]
    notes = [(rng.choice(["c", "d"]), s, s + rng.choice([0, 20, 30, 60]), strand(), rng.choice(["a", "b", "x", None]), kind()) for _ in range(90) for s in [rng.randint(0, 600)]]
    notes += [(c, s, e, st, n, t) for c, s, e, st, _, t in notes if t == "RBP" for n in "ab"]
    place = "chrom string, start long, end long, strand string"
    x, y = spark.createDataFrame(peaks, f"peakname string, {place}"), spark.createDataFrame(notes, f"{place}, gene_name string, bio_type string")
    columns = [*x.columns, "sense_gname", "sense_gtype", "antisense_gname", "antisense_gtype"]
    expected = annotate.sense_antisense(x, annotate.resolve(annotate.score_overlaps(x, y)))
    found = [sorted(map(str, map(tuple, df.select(*columns).collect()))) for df in (annotate.sides(x, y), expected)]
    assert found[0] == found[1] and any("a,b" in r for r in found[0])


def test_intron_flag_by_brute_force(spark):
    rng = random.Random(17)
    rows = lambda n, sizes: [(rng.choice(["c", None]), s, s + rng.choice(sizes), rng.choice(["+", "-", None])) for _ in range(n) for s in [rng.randint(0, 400)]]
    peaks, introns = rows(500, [0, 19, 20, 40]), rows(80, [0, 20, 21, 22, 44, 45])
    met = lambda p, i: None not in (p[0], p[3]) and (p[0], p[3]) == (i[0], i[3]) and min(p[2], i[2]) - max(p[1], i[1]) >= max(0.9 * (p[2] - p[1]), 0.9 * (i[2] - i[1]), 1)
    expected = [(*p, annotate.FULL_LENGTH_INTRON if any(met(p, i) for i in introns) else ".") for p in peaks]
    place = "chrom string, start long, end long, strand string"
    got = annotate.intron_flag(spark.createDataFrame(peaks, place), spark.createDataFrame(introns, place))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected)) and len({x[-1] for x in expected}) == 2
