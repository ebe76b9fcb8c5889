"""Hard negatives against all pairs in plain Python, with small nodes so that trees have several levels."""

import glob
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import common, negatives


def brute(rows):
    own = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(own):
        if i % 10:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), j, other == lab) for b, (j, other, w) in enumerate(own) if b != a and len(w) == len(v) and len(v)]
        for p, pid, _ in sorted(x for x in score if x[2])[:5]:
            near = sorted(x for x in score if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p)[:5]
            out += [(i, pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(near)]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 10 == 0).collect()))


def vectors(rng, n, d, labels, spread=0.3):
    middle = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(labels + 3)]
    return [(i, rng.randrange(labels), [m + rng.gauss(0, spread) for m in rng.choice(middle)]) for i in range(n)]


SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("seed", range(3))
def test_by_brute_force(spark, monkeypatch, seed):
    for name, value in {"LEAF": 4, "NODE": 24, "FANOUT": 4, "SLICES": 3, "ANCHORS": 9, "STEP": 16}.items():
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(seed)
    rows = vectors(rng, 400, 3 + 2 * seed, 3)
    rows += [(1000 + i, 1, rows[7][2]) for i in range(90)]  # a hot vector
    rows += rows[:40]  # rows that repeat, anchors among them
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2010, 1, None), (2020, 1, [1.0] * 2 + [None]), (2030, 2, [float("nan")] * 3), (2040, 1, [math.inf] * 3), (2050, 0, [1.0, 2.0]), (2051, 0, [1.0, 1.9]), (2052, 2, [1.0, 1.8]), (2060, 1, [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ("row", "size", "x", "path", "chunk", "at", "anchor", "_n", "low", "file")})
    assert mined(df) == brute(rows)


def test_defaults_and_small_tables(spark):
    rows = vectors(random.Random(5), 300, 16, 4)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0])], SCHEMA)) == []  # no other label
    assert mined(spark.createDataFrame([(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.1])], SCHEMA)) == []  # a negative score has no window
    zero = [(0, 1, [0.0]), (1, 1, [5.0]), (2, 2, [3.0])]
    assert mined(spark.createDataFrame(zero, SCHEMA)) == brute(zero) == [(0, 1, 1, 2, 0, 0)]


def test_boxes_outside_the_window_are_not_read(spark, tmp_path):
    """Clustered vectors: the search for one anchor reads few of the nodes."""
    rng = random.Random(8)
    middle = [[rng.choice([-8.0, 8.0]) for _ in range(6)] for _ in range(24)]
    own = [(i, i % 2, [m + rng.gauss(0, 0.1) for m in middle[i % 24]]) for i in range(960)]
    x = np.array([[math.floor(256 * c) for c in v] for _, _, v in own])
    tables = []
    for cluster in range(24):
        import pyarrow as pa

        at = np.arange(960) % 24 == cluster
        part = pa.table({"x": pa.array([r.tobytes() for r in x[at]], pa.binary()), "row": np.flatnonzero(at), "vec_id": np.flatnonzero(at)})
        tables.append(negatives._node(f"file://{tmp_path}", 6)((pa.scalar(cluster % 2), pa.scalar(0)), part))
    tree = negatives.Search(f"file://{tmp_path}", 6, negatives.Entries(pa.concat_tables(tables), 6))
    scores, ids = tree.positives(x[:1], np.array([0]), np.array([0]), 5)
    assert len(tree.read) == 1 and set(ids[0] % 24) == {0}
    best = np.sort((x[2::2] @ x[0]))[::-1][:5]
    assert list(scores[0]) == list(best)


def test_order_packs_whole_leaves():
    x = np.random.default_rng(1).integers(0, 1000, (1000, 5))
    order = negatives.str_order(x, 50)
    assert sorted(order) == list(range(1000))
    packed, plain = (sum(np.ptp(y[s : s + 50], axis=0).sum() for s in range(0, 1000, 50)) for y in (x[order], x))
    assert packed < 0.8 * plain


def test_files_are_removed(spark):
    root = common.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/negatives-*"))
    mined(spark.createDataFrame(vectors(random.Random(3), 60, 4, 2), SCHEMA))
    assert set(glob.glob(f"{root}/negatives-*")) == before
