"""Sums over pairs of intervals, tile by tile of the chromosome, without a row for any pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bases of a tile. What one task holds at once are the different intervals of a tile.
TILE = 5_000


def by_tiles(regions: DataFrame, intervals: DataFrame, by: list[str], f: Callable[[pa.Table, pa.Table, int, int], pa.Table], schema: str, tile: int = TILE) -> DataFrame:
    """f(regions, intervals, first, end) of each tile [first, end) of each value of by that holds both: its rows, of a schema.

    Both lie in every tile that they touch, with their whole coordinates; empty ones in none. Intervals that
    agree in all columns are one row with their number `n`, so a tile does not grow with the copies in it.
    """
    spread = lambda df: df.where(F.col("end") > F.col("start")).withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))))
    keys = [*by, "_tile"]
    counted = spread(intervals).groupBy(*intervals.columns, "_tile").agg(F.count("*").alias("n"))
    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        first = key[-1].as_py() * tile
        return f(left, right, first, first + tile).select(arrow.names)

    # one null is not another's equal
    sides = [df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).groupBy(*keys) for df in (spread(regions), counted)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, made)


#: Four times a tile's width for each level: regions of a level are at most a quarter of its tiles.
LEVELS = 16


def _placed(regions: DataFrame, intervals: DataFrame, tile: int, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both with _level and _tile: a region with those of its start (none if it is empty), an interval with all from which a region may reach it. sized: see past()."""
    reach = [tile * 4**k // 4 for k in range(LEVELS)]
    size = F.col("end") - F.col("start")
    level = F.when(size > 0, sum(((size > x).cast("int") for x in reach[:-1]), F.lit(0))).alias("_level")
    levels = sorted(r["_level"] for r in (regions if sized is None else sized).select(level).distinct().collect() if r["_level"] is not None)
    at = lambda pos, k: F.floor(pos / (tile * 4**k))
    own = F.lit(None).cast("long")
    for k in levels:
        own = F.when(F.col("_level") == k, at(F.col("start"), k)).otherwise(own)
    number = lambda k: lambda t: F.struct(F.lit(k).alias("_level"), t.alias("_tile"))
    tiles = [F.transform(F.sequence(at(F.col("start") - reach[k] + 1, k), at(F.col("end") - 1, k)), number(k)) for k in levels or [0]]
    return regions.select("*", level).withColumn("_tile", own), intervals.where("`end` > start").select("*", F.inline(F.concat(*tiles)))


def in_one_tile(regions: DataFrame, intervals: DataFrame, by: list[str], f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, tile: int = TILE, *, different: bool = False) -> DataFrame:
    """f(regions, intervals) of groups of regions: its rows, of a schema.

    A region is in one group only, of the tile in which it starts, and its group holds every interval that
    overlaps it, with its whole coordinates. Longer regions lie in wider tiles, into which intervals go only
    where there are such regions. Empty regions and intervals are in none.
    different: whether intervals that agree in all columns are one row.
    """
    placed, spread = _placed(regions.where("`end` > start"), intervals, tile)
    keys = [*by, "_level", "_tile"]
    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        return f(left, right).select(arrow.names).cast(arrow)

    left, right = (df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)) for df in (placed, spread))
    if different:  # where they lie already, so nothing is shuffled twice
        right = right.repartition(*keys).distinct()
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, made)


def past(rows: DataFrame, features: DataFrame, by: list[str], index: Callable[[pa.Table], object], answer: Callable[[object, pa.Table], pa.Table], schema: str, tile: int = TILE, *, finish: Callable[[object], pa.Table] | None = None, sized: DataFrame | None = None) -> DataFrame:
    """answer(index(features), rows) of every row, a batch of them at a time: its rows, of a schema; and finish(index) after the last rows of a tile, if given.

    Rows lie in tiles as the regions of in_one_tile() do, and stream past all features that may overlap them,
    so a task holds the features of one tile and one batch of rows, however many rows lie there. Rows that have no
    features near them, are empty or have nulls in by are answered with None for an index. The sizes in use are looked
    up first; sized: a table at hand with the starts and ends of all rows, where rows themselves take long to make.
    """
    placed, spread = _placed(rows, features, tile, sized)
    keys = [*by, "_level", "_tile"]
    ours, theirs, named = rows.columns, [f"_f_{c}" for c in features.columns], features.columns
    spread = spread.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by))
    both = placed.select(*keys, *[c for c in ours if c not in by], F.lit(1).alias("_kind")).unionByName(spread.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in named], F.lit(0).alias("_kind")), allowMissingColumns=True)
    made = StructType.fromDDL(schema)
    arrow = to_arrow_schema(made)

    def run(batches):
        at, held, found = None, [], None
        given = lambda t: t.select(arrow.names).cast(arrow).to_batches()
        for batch in batches:
            for part in _stretches(pa.Table.from_batches([batch]), [*keys, "_kind"]):
                here = tuple(part.column(c)[0].as_py() for c in keys)
                if here != at:
                    if finish and found is not None:
                        yield from given(finish(found))
                    at, held, found = here, [], None
                if part.column("_kind")[0].as_py() == 0:
                    held.append(part.select(theirs).rename_columns(named))
                    continue
                if held:
                    found, held = index(pa.concat_tables(held)), []
                yield from given(answer(found, part.select(ours)))
        if finish and found is not None:
            yield from given(finish(found))

    return both.repartition(*keys).sortWithinPartitions(*keys, "_kind").mapInArrow(run, made)


def _stretches(table: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """A table cut where any of the keys changes; nulls are alike."""
    new = np.zeros(max(len(table) - 1, 0), bool)
    for c in keys:
        x = table.column(c).combine_chunks()
        x, y = x[:-1], x[1:]
        new |= pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(table)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield table.slice(lo, hi - lo)


def numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in columns]


def dominated(x: np.ndarray, y: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of (a, b) the sum of w over the points with x < a and y < b.

    Points in the order of x are parted by the bits of their y's rank, the highest first; a range of
    them stays a range in either part. So the work is (points + questions) * log(different y).
    """
    order = np.argsort(x, kind="stable")
    values, rank = np.unique(y, return_inverse=True)
    rank, w = rank[order], w[order]
    hi = np.searchsorted(x[order], a)
    lo, upto, out = np.zeros_like(hi), np.searchsorted(values, b), np.zeros(len(hi), np.int64)
    for bit in reversed(range(len(values).bit_length())):
        low = (rank >> bit) & 1 == 0
        zeros, sums = np.concatenate([[0], np.cumsum(low)]), np.concatenate([[0], np.cumsum(np.where(low, w, 0))])
        up = (upto >> bit) & 1 == 1
        out += np.where(up, sums[hi] - sums[lo], 0)
        lo, hi = (np.where(up, zeros[-1] + i - zeros[i], zeros[i]) for i in (lo, hi))
        part = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
        rank, w = rank[part], w[part]
    return out


def ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges lo to hi one after the other: whose each place is, and the places."""
    n = np.maximum(hi - lo, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)


def colours(column: pa.ChunkedArray) -> np.ndarray:
    """A number from 0 for each different value, -1 for null."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
