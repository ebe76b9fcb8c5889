"""Every pair of small sets shares a signature; sets with too few parts and equal numbers of sets lose no link."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import common, jaccard
from tests.llm.test_operators import classes, documents, shingles, text


@pytest.mark.parametrize("size", range(1, 13))
def test_similar_small_sets_share_a_signature(size):
    rng = random.Random(size)
    for _ in range(60):
        a = [rng.getrandbits(64) for _ in range(size)]
        other = rng.randint(int(np.ceil(0.75 * size)), int(size / 0.75))
        held = int(np.ceil(0.75 * (size + other) / 1.75 - 1e-9))
        if held > min(size, other):
            continue
        b = rng.sample(a, held) + [rng.getrandbits(64) for _ in range(other - held)]
        x, y = (np.sort(np.array(v, np.uint64)) for v in (a, b))
        shared = set(jaccard.schemes(size, 0.75)) & set(jaccard.schemes(other, 0.75))
        assert any(len(np.intersect1d(jaccard.signatures(x, g, 0.75), jaccard.signatures(y, g, 0.75))) for g in shared)


def test_few_signatures_for_small_sets():
    assert all(len(jaccard.signatures(np.arange(n, dtype=np.uint64), jaccard.SMALL, 0.75)) <= n + 2 for n in (4, 5, 6, 7))


def table(rng):
    base = text(rng, 120).split()
    rows = [(i, " ".join(base[rng.randint(0, 6) :] if i % 3 else text(rng, rng.randint(60, 130)).split())) for i in range(30)]
    rows += [(100 + i, " ".join(text(rng, 10).split() if i % 2 else base[: rng.randint(7, 10)] + text(rng, 1).split())) for i in range(40)]
    return rows


def aside(spark, rows, few, one_number):
    """_aside() over sets of which some are told to have too few parts, or all to have one number."""
    docs = documents(spark, rows).select("doc_id", "text")
    reps = spark.createDataFrame([(i, 7 if one_number else i, len(shingles(t))) for i, t in rows], "rep long, fid long, size long")
    by = reps.withColumn("parts", F.when(F.col("rep").isin(few), 1).otherwise(10**6).cast("long"))
    return {(r.a, r.b) for r in jaccard._aside(docs, reps, by, 5, 0.75).collect()}


def test_sets_with_too_few_parts_meet_all_that_share_a_shingle(spark):
    rows = table(random.Random(11))
    few = [rows[1][0], rows[35][0], rows[50][0]]
    expected = {tuple(sorted((i, j))) for i, t in rows if i in few for j, u in rows if i != j and shingles(t) & shingles(u)}
    assert aside(spark, rows, few, False) == expected and len(expected) > 20
    assert aside(spark, rows, [], False) == set()


def test_sets_with_one_number_are_all_compared(spark):
    rows = table(random.Random(12))[:9]
    assert aside(spark, rows, [], True) == {(i, j) for i, _ in rows for j, _ in rows if i < j}


def test_nothing_but_the_result_stays(spark):
    rows = table(random.Random(13))
    with common.scratch(spark):
        out = jaccard.near_duplicates(documents(spark, rows))
        assert {n for n, _ in common._held[-1]} == {"jaccard-sets", "jaccard-classes"}
        assert out.count() == len(rows)


@pytest.mark.parametrize("sub", [3, 512])
def test_blocks_give_the_links_that_join_components(monkeypatch, sub):
    monkeypatch.setattr(jaccard, "SUB", sub)
    rng = np.random.default_rng(sub)
    base = [np.unique(rng.integers(0, 10**6, 60, dtype=np.uint64)) for _ in range(3)]
    sets_ = [np.unique(np.r_[base[i % 3][int(rng.integers(0, 12)) :], rng.integers(0, 10**6, int(rng.integers(0, 10)), dtype=np.uint64)]) for i in range(20)]
    side = [0 if i < 10 else 1 for i in range(20)]
    near = {(i, j) for i in range(20) for j in range(i + 1, 20) if side[i] != side[j] and 100 * (k := len(np.intersect1d(sets_[i], sets_[j]))) >= 75 * (len(sets_[i]) + len(sets_[j]) - k)}
    import pyarrow as pa

    table = pa.table({"rep": list(range(20)), "side": side, "label": list(range(20)), "grams": pa.array([x.tobytes() for x in sets_], pa.binary())})
    links = list(zip(*jaccard._compare(75)(table).to_pydict().values()))
    assert near and set(links) <= near

    def groups(edges):
        root = list(range(20))
        for _ in range(20):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(links) == groups(near)
