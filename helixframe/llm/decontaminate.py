"""Benchmark decontamination by greedy string tiling.

Seeds are grams of TILE tokens that a document and a test item share. A bitmap of fixed size lets
only those grams of the documents through that an item may have; these are joined with the items'
seeds by Spark. Any tiling that covers enough of an item holds a number of its seeds, so the most
frequent ones of each item are left out of the join. Pairs that come out are tiled: the longest
match of unmarked tokens, found by running Karp-Rabin hashes, is marked again and again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bitmap, in_map, mix, ngrams, slices, small, small_bytes, stage, text_buffers, trimmed, words

#: Tokens of the shortest tile, and of the grams that seed matches.
TILE = 4
#: Share of a test item's tokens that tiles must cover.
COVERAGE = 0.5
#: Bytes of the items' seeds, and tokens of the items, up to which they are broadcast.
BROADCAST, BLOCK_TOKENS = 16 << 20, 2_000_000

#: Bytes between tokens: ASCII other than letters and digits.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _tokens(col: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's tokens."""
    doc, _, h = words(*text_buffers(col), _BETWEEN)
    at = np.searchsorted(doc, np.arange(len(col) + 1))
    return [h[s:e] for s, e in zip(at[:-1], at[1:])]


def grams(tokens: np.ndarray, n: int) -> np.ndarray:
    return ngrams(tokens, n) if n == TILE else mix(ngrams(tokens, n) ^ np.uint64(n))


def _items(batches):
    """Items with at least one token to (item, item_id, length, tokens, seeds); an item of fewer than TILE tokens has itself as its only seed."""
    names = ["item", "item_id", "length", "tokens", "seeds"]
    seed = pa.list_(pa.struct([("seed", pa.int64()), ("times", pa.int32())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            for n, i, h in zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist(), _tokens(batch.column("text"))):
                if len(h):
                    own, times = np.unique(grams(h, min(TILE, len(h))), return_counts=True)
                    rows.append((n, i, len(h), h.tobytes(), [{"seed": x, "times": t} for x, t in zip(own.view(np.int64).tolist(), times.tolist())]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), seed))], names)


class _Side:
    """Running Karp-Rabin hashes over tokens of which some are marked."""

    def __init__(self, tokens: np.ndarray, free: np.ndarray, base: int):
        self.free = free.copy()
        n = len(tokens)
        with np.errstate(over="ignore"):
            self.power = np.full(n + 1, base, np.uint64)
            self.power[0] = 1
            self.power = np.cumprod(self.power)
            self.total = np.r_[np.uint64(0), np.cumsum(mix(tokens) * self.power[n - 1 :: -1][:n])] if n else np.zeros(1, np.uint64)
        self.n = n

    def left(self) -> np.ndarray:
        """The free tokens from each place on."""
        stop = np.where(self.free, self.n, np.arange(self.n))
        return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(self.n)

    def windows(self, left: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of free windows of s tokens, and their hashes."""
        at = np.flatnonzero(left[: self.n - s + 1] >= s) if s <= self.n else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            return at, (self.total[at + s] - self.total[at]) * self.power[at]


def tile(doc: np.ndarray, item: np.ndarray, under: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item by a document: tiles (place in document, place in item, length).

    under: the document's tokens that lie in a seed. The longest matches of unmarked tokens are marked
    first (ties: the first in the item, then in the document), down to TILE tokens. Time and memory
    grow with the lengths, not with the number of places that agree.
    """
    base = 0x9E3779B97F4A7C15
    a, b = _Side(doc, under, base), _Side(item, np.ones(len(item), bool), base)
    # hashes of both sides are brought to one power, so that windows compare wherever they lie
    shift = np.uint64(pow(base, abs(a.n - b.n), 1 << 64))
    with np.errstate(over="ignore"):
        if a.n < b.n:
            a.total = a.total * shift
        else:
            b.total = b.total * shift
    tiles, s = [], len(item)
    while s >= TILE:
        la, lb = a.left(), b.left()
        s = min(s, int(la.max(initial=0)), int(lb.max(initial=0)))

        def found(n: int) -> bool:
            return len(np.intersect1d(a.windows(la, n)[1], b.windows(lb, n)[1])) > 0

        if s < TILE or not found(s):
            low, high = TILE - 1, s  # found(low) holds (or low is too short), found(high) does not
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if found(mid) else (low, mid)
            s = low
        if s < TILE:
            break
        at_a, ha = a.windows(la, s)
        at_b, hb = b.windows(lb, s)
        both = np.intersect1d(ha, hb)
        keep = np.isin(ha, both)
        order = np.argsort(ha[keep], kind="stable")
        places, hashes = at_a[keep][order], ha[keep][order]
        pointer = dict(zip(both.tolist(), np.searchsorted(hashes, both).tolist()))
        marked = False
        for y, h in zip(at_b[np.isin(hb, both)].tolist(), hb[np.isin(hb, both)].tolist()):
            if not b.free[y : y + s].all():
                continue
            k = pointer[h]
            while k < len(places) and hashes[k] == h and not a.free[places[k] : places[k] + s].all():
                k += 1
            pointer[h] = k
            if k < len(places) and hashes[k] == h:
                x = int(places[k])
                a.free[x : x + s] = b.free[y : y + s] = False
                tiles.append((x, y, s))
                marked = True
        if not marked:
            break
    return tiles


def cover(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """The tokens of an item that tiles of a document cover, and the number of tiles; an item of fewer than TILE tokens is covered as a whole or not."""
    n = min(TILE, len(item))
    own = grams(doc, n)
    seeds = np.isin(own, grams(item, n))
    if not seeds.any():
        return 0, 0
    if n < TILE:
        return n, 1
    # the tokens under seeds, with one token that matches nothing between stretches
    under = np.zeros(len(doc) + 1, np.int64)
    np.add.at(under, np.flatnonzero(seeds), 1)
    np.add.at(under, np.flatnonzero(seeds) + TILE, -1)
    places = np.flatnonzero(np.cumsum(under)[:-1] > 0)
    stretch = np.cumsum(np.diff(places, prepend=places[0]) > 1)
    spread = places * 0 + np.arange(len(places)) + stretch
    part, free = np.zeros(spread[-1] + 1, np.uint64), np.zeros(spread[-1] + 1, bool)
    part[spread], free[spread] = doc[places], True
    tiles = tile(part, item, free)
    return sum(t[2] for t in tiles), len(tiles)


def _seeds_of(sent):
    """(key, text) to (key, seed): the distinct grams of each text that the map lets through."""
    bits, lengths = sent.value

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for row, h in enumerate(_tokens(batch.column("text"))):
                    for n in lengths:
                        g = grams(h, n)
                        g = np.unique(g[in_map(g, bits)])
                        seeds.append(g), rows.append(np.full(len(g), row))
                seeds, rows = np.concatenate(seeds), np.concatenate(rows)
                if len(seeds):
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array(seeds.view(np.int64))], ["key", "seed"])

    return run


def _tile_all(batches):
    """(key, text, item_id, tokens of the item) to the pairs that are covered enough."""
    names, types = ["key", "item_id", "coverage", "tokens", "tiles"], (pa.binary(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
    key, doc = None, np.zeros(0, np.uint64)
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            for i in range(batch.num_rows):
                if batch.column("key")[i].as_py() != key:
                    key, doc = batch.column("key")[i].as_py(), _tokens(batch.column("text").slice(i, 1))[0]
                item = np.frombuffer(batch.column("tokens")[i].as_py(), np.uint64)
                tokens, tiles = cover(doc, item)
                if tokens >= COVERAGE * len(item):
                    rows.append((key, batch.column("item_id")[i].as_py(), tokens / float(len(item)), tokens, tiles))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _key():
    return F.unhex(F.md5("text")).alias("key")


def leaked(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """texts(key, text) to (key, item_id, coverage, tokens, tiles) for each different text and item."""
    texts = texts.where("text IS NOT NULL")
    told = benchmark.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = stage(told.mapInArrow(_items, "item long, item_id long, length int, tokens binary, seeds array<struct<seed:long,times:int>>"), "leaks-items")
    seeds = items.select("item", "length", F.inline("seeds"))
    lengths = sorted(r.n for r in items.select(F.least("length", F.lit(TILE)).alias("n")).distinct().collect())
    sent = texts.sparkSession.sparkContext.broadcast((bitmap(seeds), lengths))
    found = stage(texts.select("key", "text").mapInArrow(trimmed(_seeds_of(sent)), "key binary, seed long").distinct(), "leaks-seeds")
    # a tile of n tokens holds n - TILE + 1 seeds, so a tiling that covers enough holds this many at least: an item's most frequent ones, fewer than that, need not be looked for
    held = F.ceil(F.ceil(F.lit(COVERAGE) * F.col("length")) / TILE)
    order = Window.partitionBy("item").orderBy(F.desc("often"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    ranked = seeds.join(found.groupBy("seed").agg(F.count("*").alias("often")), "seed").withColumn("so_far", F.sum("times").over(order))
    wanted = stage(ranked.where(F.col("so_far") >= held).select("item", "seed"), "leaks-wanted")
    pairs = stage(found.join(small_bytes(wanted, F.lit(16), BROADCAST), "seed").select("key", "item").distinct(), "leaks-pairs")
    need = small(stage(pairs.select("key").distinct(), "leaks-keys"))
    mine = stage(texts.join(need, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "leaks-texts")
    both = mine.join(small(pairs), "key").join(small_bytes(items.select("item", "item_id", "tokens", "length"), F.col("length"), BLOCK_TOKENS), "item")
    return stage(both.select("key", "text", "item_id", "tokens").mapInArrow(trimmed(_tile_all), "key binary, item_id long, coverage double, tokens int, tiles int"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, tokens, tiles): documents of which tiles cover half of a test item or more.

    Tokens are runs of letters and digits, A-Z lower-cased; punctuation and order of passages do not
    matter, tiles of fewer than TILE tokens do not count. Items of fewer tokens are found where they
    stand as a whole. Documents and items with null text or without tokens match nothing. Null ids
    stay null, repeated rows give repeated rows, ties of tiles go to the first in the item; empty
    tables give none; other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(), "text")
    return keyed.select("doc_id", "key").join(small(leaked(keyed.select("key", "text"), benchmark)), "key").select("doc_id", "item_id", "coverage", "tokens", "tiles")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with all its columns, less the rows that leaks() would name; null and empty texts stay."""
    gone = small(stage(leaked(docs.select(_key(), "text"), benchmark).select(F.col("key").alias("_leaked")).distinct(), "leaks-gone"))
    return docs.join(gone, F.unhex(F.md5(docs["text"])) == gone["_leaked"], "left_anti")
