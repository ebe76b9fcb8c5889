"""Greedy string tiling against a plain version, short items, repeated tokens and clashing columns."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import common, decontaminate
from tests.llm.test_operators import documents


def tokens(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def tiling(doc, item, least=4):
    """Longest unmarked match again and again, every pair of places compared."""
    da, ib, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for y in range(len(item)):
            for x in range(len(doc)):
                n = 0
                while x + n < len(doc) and y + n < len(item) and doc[x + n] == item[y + n] and not da[x + n] and not ib[y + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (x, y, n)
        if best is None:
            return tiles
        for k in range(best[2]):
            da[best[0] + k] = ib[best[1] + k] = True
        tiles.append(best)


def test_tiles_of_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        words = rng.randint(2, 12)
        doc, item = [[rng.randrange(words) for _ in range(rng.randint(4, n))] for n in (40, 24)]
        h = lambda x: np.array([hash((v, "t")) & (1 << 63) - 1 for v in x], np.uint64)
        got = decontaminate.tile(h(doc), h(item), np.ones(len(doc), bool))
        assert got == tiling(doc, item), (doc, item)
        assert decontaminate.cover(h(doc), h(item)) == (sum(t[2] for t in got), len(got))


def test_leaks_of_random_tables(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 20])))) for i in range(20)] + [(3, "w1 w2 w3 w4 w5 w6")]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if i % 2:
            own = rng.choice(items)[1].split()
            cut = rng.randint(0, len(own))
            w[len(w) // 2 : len(w) // 2] = own[cut:] + w[:2] + own[:cut]
        rows.append((i, " ".join(w)))
    rows += [rows[1], (None, rows[1][1]), (70, None)]
    expected = []
    for i, t in rows:
        for j, u in items:
            d, k = tokens(t), tokens(u)
            n = min(4, len(k))
            found = tiling(d, k, n)
            covered = sum(x[2] for x in found) if n == 4 else len(k) if any(d[x : x + n] == k for x in range(len(d))) else 0
            if covered and covered >= 0.5 * len(k):
                expected.append((i is None, i or 0, j, covered, len(found) if n == 4 else 1))
    docs = documents(spark, rows).withColumns({"key": F.lit("k"), "seed": F.lit(1), "tokens": F.lit(2), "item": F.lit(3), "item_id": F.lit(4), "_leaked": F.lit(5)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(0))
    got = [(r.doc_id is None, r.doc_id or 0, r.item_id, r.tokens, r.tiles) for r in decontaminate.leaks(docs.repartition(3), bench).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 20
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i is not None and not any(x[1] == i and not x[0] for x in expected))


def test_repeated_tokens_take_no_product():
    began = time.time()
    doc, item = np.zeros(200_000, np.uint64), np.zeros(5_000, np.uint64)
    assert decontaminate.cover(doc, item) == (5_000, 1)
    rng = np.random.default_rng(1)
    decontaminate.cover(rng.integers(0, 3, 20_000).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64))
    assert time.time() - began < 30


def test_the_map_lets_all_seeds_through(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(-(1 << 63), 1 << 63, 5000)
    bits = common.bitmap(spark.createDataFrame([(int(x),) for x in seeds], "seed long"))
    assert common.in_map(seeds.view(np.uint64), bits).all()
    assert common.in_map(rng.integers(0, 1 << 63, 20_000).astype(np.uint64), bits).mean() < 0.01
