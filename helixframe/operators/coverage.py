"""Coverage runs, depth per region, protection scores and segments, all by signed events and running sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .interval_join import chained, interval_join, merge_intervals, same, without_keys
from .tiles import colours, dominated, in_one_tile, numbers, ragged

#: Bases of a tile: coverage is summed up within tiles, so no chromosome is one task.
TILE = 100_000


def _runs(parts: DataFrame, by: list[str], tile: int, tiles: DataFrame | None = None) -> DataFrame:
    """(by, tile, start, end, depth): running sums of parts(by, start, end, w) between the places where they change, tile by tile.

    Each part is clipped to the tiles it covers, so a tile's running sum needs nothing from before it.
    tiles(by, tile, start, end): tiles that are filled from end to end.
    """
    f = parts.where(F.col("end") > F.col("start")).select(*by, "start", "end", "w", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))).alias("tile"))
    lo, hi = F.greatest("start", F.col("tile") * tile), F.least("end", (F.col("tile") + 1) * tile)
    step = lambda pos, d: F.struct(pos.alias("pos"), d.cast("long").alias("d"))
    events = f.select(*by, "tile", F.inline(F.array(step(lo, F.col("w")), step(hi, -F.col("w")))))
    if tiles is not None:
        events = events.unionByName(tiles.select(*by, "tile", F.inline(F.array(step(F.col("start"), F.lit(0)), step(F.col("end"), F.lit(0))))))
    steps = events.groupBy(*by, "tile", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by, "tile").orderBy("pos")
    return steps.select(*by, F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w).alias("depth")).where("end IS NOT NULL")


def coverage_runs(fragments: DataFrame, sizes: DataFrame | None = None, stranded: bool = False, tile: int = TILE, merged: bool = True) -> DataFrame:
    """(chrom, [strand], start, end, depth): maximal runs of equal depth; with sizes(chrom, size) also of depth 0. Equal neighbours are merged at last, if wanted."""
    by = ["chrom", *(["strand"] if stranded else [])]
    tiles = None
    if sizes is not None:
        whole = sizes if not stranded else sizes.join(fragments.select("strand").distinct())
        tiles = whole.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / tile))).alias("tile"))
        tiles = tiles.select(*by, "tile", (F.col("tile") * tile).alias("start"), F.least("size", (F.col("tile") + 1) * tile).alias("end"))
    runs = _runs(fragments.select(*by, "start", "end", F.lit(1).alias("w")), by, tile, tiles)
    if sizes is None:
        runs = runs.where("depth > 0")
    return merge_equal(runs, by, "depth", tile) if merged else runs


def merge_equal(runs: DataFrame, by: list[str], value: str, tile: int = TILE) -> DataFrame:
    """Neighbouring runs that touch and have one value, as one run."""
    runs = chained(runs, by, "_run", value=value, tile=tile)
    return runs.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(value).alias(value)).drop("_run")


def _own(key: list[str], flags: dict) -> list[str]:
    """What tells regions apart: the caller's key and the coordinates, so that names may repeat."""
    return list(dict.fromkeys([*key, "chrom", "start", "end", *(["strand"] if flags.get("strand") else [])]))


def region_steps(regions: DataFrame, fragments: DataFrame, key: list[str], tile: int = TILE, **flags) -> DataFrame:
    """(key and coordinates, pos, to, depth): stretches of equal depth inside each different region.

    Regions meet the runs of coverage, whose number is bounded by the bases, not the fragments.
    """
    own = _own(key, flags)
    runs = coverage_runs(fragments, stranded=flags.get("strand") is not None, tile=tile, merged=False)
    hits = interval_join(regions.select(*own).distinct(), runs, **flags)
    return hits.select(*own, F.greatest("start", "b_start").alias("pos"), F.least("end", "b_end").alias("to"), F.col("b_depth").alias("depth"))


def _back(regions: DataFrame, found: DataFrame, own: list[str]) -> DataFrame:
    """Every row of regions, with what was found for it."""
    return without_keys(same(regions.select(*own), found, own, "left"), own)


def _by_place(flags: dict) -> list[str] | None:
    """The columns within whose values regions and fragments meet, or None if more than overlap and strand decide."""
    if flags.get("strand") not in (None, "same") or set(flags) - {"wide", "strand", "tile"}:
        return None
    return ["chrom", *(["strand"] if flags.get("strand") else [])]


def _runs_of(regions: DataFrame, fragments: DataFrame, by: list[str], f, schema: str, runs_tile: int = TILE) -> DataFrame:
    """f(regions, runs) of regions and the runs of coverage that overlap them, tile by tile; the runs of a tile are disjoint and in order."""
    runs = coverage_runs(fragments, stranded="strand" in by, tile=runs_tile, merged=False)

    def run(r, i):
        return f(r, i.sort_by("start"))

    return in_one_tile(regions, runs, by, run, schema)


def _highest(a: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The largest depth of the disjoint runs [s, e), in order, that overlap each [a, b); 0: none. Two stretches of 2^k runs cover those of any region."""
    lo, hi = np.searchsorted(e, a, side="right"), np.searchsorted(s, b)
    out = np.zeros(len(a), np.int64)
    width = 1
    while True:
        here = (hi - lo >= width) & (hi - lo < 2 * width)
        out[here] = np.maximum(depth[lo[here]], depth[hi[here] - width])
        if len(depth) <= width:
            return out
        depth = np.maximum(depth[:-width], depth[width:])
        width *= 2


def pileup(regions: DataFrame, fragments: DataFrame, key: list[str], **flags) -> DataFrame:
    """(key, pileup) of each row of regions: the largest depth inside it, 0 where nothing overlaps. Without fractions and conditions no pair becomes a row."""
    own = _own(key, flags)
    by = _by_place(flags)
    if by is None:
        top = region_steps(regions, fragments, key, **flags).groupBy(*own).agg(F.max("depth").alias("pileup"))
        return _back(regions, top, own).select(*key, F.coalesce("pileup", F.lit(0).cast("long")).alias("pileup"))
    place = [*by, "start", "end"]

    def highest(r, i):
        top = _highest(*numbers(r, "start", "end"), *numbers(i, "start", "end", "depth"))
        return r.append_column("pileup", pa.array(top))

    regions = regions.select(*own)
    places = regions.select(*place).distinct()
    top = _runs_of(places, fragments, by, highest, _schema(places, place, "pileup long"), flags.get("tile", TILE))
    return without_keys(same(regions, top, place, "left"), place).select(*key, F.coalesce("pileup", F.lit(0).cast("long")).alias("pileup"))


def _schema(df: DataFrame, columns: list[str], more: str) -> str:
    return ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns], more])


def distinct_covering(regions: DataFrame, fragments: DataFrame, key: list[str], column: str, tile: int = TILE) -> DataFrame:
    """(key, <column>_count): in how many samples (or other values of a column) a fragment overlaps each different region; regions without any are left out.

    Each sample's fragments are merged first. A sample misses a region that lies in a gap between its
    islands, so gaps are counted, and no pair of region and island becomes a row.
    """
    own, place = _own(key, {}), ["chrom", "start", "end"]
    # a struct, as missing values would not meet in a join
    islands = merge_intervals(fragments.where("`end` > start").withColumn("_of", F.struct(column)), tile=tile, also=["_of"]).select(*place, f"_of.{column}")

    def count(r, i):
        (a, b), (s, e), u = numbers(r, "start", "end"), numbers(i, "start", "end"), colours(i.column(column))
        order = np.lexsort((s, u))
        s, e, u = s[order], e[order], u[order]
        met = np.zeros(len(a), np.int64)  # a missing value is no sample, but its fragments overlap
        known = u >= 0
        if known.any():
            x, y, w = s[known], e[known], u[known]
            new = np.concatenate([[True], w[1:] != w[:-1]])
            low, high = min(a.min(), x.min()), max(b.max(), y.max())
            g0 = np.concatenate([np.where(new, low, np.roll(y, 1)), y[np.concatenate([new[1:], [True]])]])
            g1 = np.concatenate([x, np.full(new.sum(), high)])
            met = new.sum() - dominated(g0, -g1, np.ones_like(g0), a + 1, 1 - b)
        hit = met > 0
        if not known.all():
            x, y = np.sort(s[~known]), np.sort(e[~known])
            hit |= np.searchsorted(x, b) > np.searchsorted(y, a, side="right")
        return r.append_column("_n", pa.array(met)).filter(pa.array(hit))

    regions = regions.select(*own).distinct()
    places = regions.select(*place).distinct()
    found = in_one_tile(places, islands, ["chrom"], count, _schema(places, place, "_n long"))
    return without_keys(same(regions, found, place, "inner"), place).select(*key, F.col("_n").alias(f"{column}_count"))


def summits(regions: DataFrame, fragments: DataFrame, key: list[str], **flags) -> DataFrame:
    """(key, summit, depth) of each different region with coverage: the first position of the largest depth."""
    steps = region_steps(regions, fragments, key, **flags)
    # depth and place as one number, which is kept in place; a struct would have every step sorted
    size, place = F.col("end") - F.col("start"), F.col("pos") - F.col("start")
    found = steps.groupBy(*_own(key, flags)).agg(F.max(F.col("depth") * size + size - 1 - place).alias("_code"))
    return found.select(*key, (F.col("end") - 1 - F.col("_code") % size).alias("summit"), F.expr("_code DIV (`end` - start)").alias("depth"))


def breadth(regions: DataFrame, fragments: DataFrame, key: list[str], cutoff: int, **flags) -> DataFrame:
    """(key, mean_depth, breadth) of each row of regions: mean depth of its bases, and the share of them at cutoff or more."""
    own = _own(key, flags)
    steps = region_steps(regions, fragments, key, **flags).groupBy(*own).agg(
        F.sum((F.col("to") - F.col("pos")) * F.col("depth")).alias("_bases"), F.sum(F.when(F.col("depth") >= cutoff, F.col("to") - F.col("pos")).otherwise(0)).alias("_deep")
    )
    size = F.col("end") - F.col("start")
    return _back(regions, steps, own).select(*key, (F.coalesce("_bases", F.lit(0)) / size).alias("mean_depth"), (F.coalesce("_deep", F.lit(0)) / size).alias("breadth"))


def depth_histogram(regions: DataFrame, fragments: DataFrame, key: list[str], **flags) -> DataFrame:
    """(key, depth, bases) of each different region, for depths over 0.

    Without fractions and conditions a region's histogram is made in one tile with the region's names, so
    nothing as long as the result is shuffled.
    """
    own = _own(key, flags)
    by = _by_place(flags)
    if by is None:
        steps = region_steps(regions, fragments, key, **flags).where("depth > 0")
        return steps.groupBy(*own, "depth").agg(F.sum(F.col("to") - F.col("pos")).alias("bases")).select(*key, "depth", "bases")

    def histogram(r, i):
        (a, b), (s, e, depth) = numbers(r, "start", "end"), numbers(i, "start", "end", "depth")
        places, of = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
        a, b = places
        at, j = ragged(np.searchsorted(e, a, side="right"), np.searchsorted(s, b))
        bases = np.minimum(e[j], b[at]) - np.maximum(s[j], a[at])
        order = np.lexsort((depth[j], at))
        at, d, bases = at[order], depth[j][order], bases[order]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (d[1:] != d[:-1])])) if len(at) else at
        at, d, bases = at[new], d[new], np.add.reduceat(bases, new) if len(new) else bases
        ends = np.searchsorted(at, np.arange(len(a) + 1))
        row, k = ragged(ends[of.ravel()], ends[of.ravel() + 1])
        return pa.table([*[r.column(c).take(pa.array(row)) for c in key], pa.array(d[k]), pa.array(bases[k])], names=[*key, "depth", "bases"])

    different = regions.select(*own).distinct()
    return _runs_of(different, fragments, by, histogram, _schema(different, key, "depth long, bases long"), flags.get("tile", TILE))


def mean_signal(regions: DataFrame, track: DataFrame, key: list[str], **flags) -> DataFrame:
    """(key, mean_signal) of each row of regions: the mean of a run-length track(chrom, start, end, value) over it, gaps as 0."""
    own = _own(key, flags)
    hits = interval_join(regions.select(*own).distinct(), track, **flags).groupBy(*own).agg(F.sum(F.col("b_value") * F.col("overlap")).alias("_sum"))
    return _back(regions, hits, own).select(*key, (F.coalesce("_sum", F.lit(0)) / (F.col("end") - F.col("start"))).alias("mean_signal"))


def protection(regions: DataFrame, fragments: DataFrame, key: list[str], window: int = 10, share: float = 0.8, tile: int = TILE, **flags) -> DataFrame:
    """(key, protected) of each row of regions: bases whose protection score is over share of the region's highest, by the region's length.

    Score: +1 under a fragment, -1 in the half window beyond either end, on [start, end + window); a
    base that nothing reaches scores 0. Scores are summed up once along the chromosome, so regions
    meet their runs, and nothing grows with depth.
    """
    half = window // 2
    own = _own(key, flags)
    by = ["chrom", *(["strand"] if flags.get("strand") else [])]
    part = lambda s, e, w: F.struct(s.alias("start"), e.alias("end"), F.lit(w).alias("w"))
    s, e = F.col("start"), F.col("end")
    parts = fragments.where(e > s).select(*by, F.inline(F.array(part(s - half, s, -1), part(s, e, 1), part(e, e + half, -1))))
    runs = _runs(parts, by, tile).where("depth <> 0")
    regions_ = regions.select(*own).distinct().withColumns({"_end": e, "end": e + window})
    # regions meet the runs twice, for their highest score and for the bases over its share: either leaves a number or two for each region, kept in place as pairs arise
    top = interval_join(regions_, runs, **flags).groupBy(*own, "_end").agg(F.max("b_depth").alias("top"), F.sum("overlap").alias("covered"))
    top = top.withColumn("top", F.when(F.col("covered") < e - s, F.greatest("top", F.lit(0).cast("long"))).otherwise(F.col("top"))).drop("covered")
    over = F.col("b_depth") > share * F.col("top")
    found = interval_join(top, runs, where=over, **flags).groupBy(*own, "_end").agg(F.sum("overlap").alias("n"))
    found = found.withColumn("end", F.col("_end")).drop("_end")
    return _back(regions, found, own).select(*key, (F.coalesce("n", F.lit(0)) / (e - s)).alias("protected"))


def best_stretch(runs: DataFrame, by: list[str], tile: int = TILE, most: tuple[str, ...] = ()) -> DataFrame:
    """(by, start, end, gain, most): of each group's disjoint runs(by, start, end, gain) the stretch of neighbours with the largest sum of gain, and the largest values that the group has of the columns most.

    Ties go to the stretch that starts first, then to the longest. A tile's runs are folded into a
    summary (its sum, its best prefix, suffix and stretch); summaries of tiles fold alike, so a group
    of any length is as many summaries as it has tiles.
    """
    s, e, g = F.col("start"), F.col("end"), F.col("gain").cast("double")
    best = lambda v, s, e: F.struct(v.alias("v"), (-s).alias("s"), e.alias("e"))
    one = F.struct(s.alias("at"), g.alias("sum"), best(g, s, e).alias("pre"), best(g, s, e).alias("suf"), best(g, s, e).alias("best"))

    def merge(a: Column, b: Column) -> Column:
        pre = F.greatest(a["pre"], best(a["sum"] + b["pre"]["v"], -a["pre"]["s"], b["pre"]["e"]))
        suf = F.greatest(b["suf"], best(b["sum"] + a["suf"]["v"], -a["suf"]["s"], b["suf"]["e"]))
        both = F.greatest(a["best"], b["best"], best(a["suf"]["v"] + b["pre"]["v"], -a["suf"]["s"], b["pre"]["e"]))
        return F.struct(a["at"].alias("at"), (a["sum"] + b["sum"]).alias("sum"), pre.alias("pre"), suf.alias("suf"), both.alias("best"))

    def fold(df: DataFrame, keys: list[str], summary: Column) -> DataFrame:
        rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(summary)).alias("_l"), *[F.max(c).alias(c) for c in most])
        return rows.select(*keys, F.aggregate(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), F.col("_l")[0], merge).alias("_s"), *most)

    inner = fold(runs.withColumn("_tile", F.floor(s / tile)), [*by, "_tile"], one)
    found = fold(inner, by, F.col("_s"))
    return found.select(*by, (-F.col("_s.best.s")).alias("start"), F.col("_s.best.e").alias("end"), F.col("_s.best.v").alias("gain"), *most)


def _median(runs: Column, bases: Column) -> Column:
    """The median of so many bases, of which runs (an array of start, end, depth) give some their depth and the others have 0."""
    low, high = F.floor((bases - 1) / 2), F.floor(bases / 2)
    each = F.array_sort(F.transform(runs, lambda x: F.struct(x["depth"].cast("double").alias("d"), (x["end"] - x["start"]).alias("n"))))
    zeros = bases - F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    start = F.struct(zeros.alias("n"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    at = lambda acc, x, place, had: F.when((acc["n"] <= place) & (place < acc["n"] + x["n"]), x["d"]).otherwise(had)
    step = lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), at(acc, x, low, acc["lo"]).alias("lo"), at(acc, x, high, acc["hi"]).alias("hi"))
    return F.aggregate(each, start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def segments(track: DataFrame, cutoff: Column | float, gap: int = 10, least: int = 40, short: int = 150, most: int = 450, accept: tuple[int, int] = (50, 150), over: int = 5, tile: int | None = None) -> DataFrame:
    """(chrom, start, end, top, center): segments of a run-length track(chrom, start, end, depth) of disjoint runs.

    Islands are runs over the cutoff with gaps of at most gap bases; those of least to most bases
    count. Each is cut into pieces: neighbouring runs at or above the median of its bases (of which
    those in gaps count as 0). A piece's stretch with the largest sum of (depth - median) is a
    segment: in islands up to short bases the one with the largest sum, if it has more than over
    bases; in longer ones each whose length lies between accept, both ends excluded. top: the largest
    depth, center: the middle.

    Definitions of our own, where the rule leaves them open: the median counts bases; which piece of
    a short island counts; ties go to the piece that starts first. Chains across tiles tell an
    island's length before anything is gathered, so what is gathered has at most `most` bases.
    """
    tile = tile or TILE
    size = F.col("end") - F.col("start")
    isl = chained(track.where(F.col("depth") > cutoff).select("chrom", "start", "end", "depth"), ["chrom"], "island", gap=gap, tile=tile, end="till")
    isl = isl.withColumn("len", F.col("till") - F.col("island")).where(F.col("len").between(least, most))
    isl = isl.groupBy("chrom", "island", "len").agg(F.collect_list(F.struct("start", "end", "depth")).alias("runs"))
    isl = isl.withColumn("median", _median(F.col("runs"), F.col("len"))).select("chrom", "island", "len", "median", F.inline("runs"))
    high = isl.where(F.col("depth") >= F.col("median")).withColumn("gain", (F.col("depth") - F.col("median")) * size)
    high = chained(high, ["chrom"], "piece", gap=0, tile=tile)  # pieces of different islands lie further apart than gap
    found = best_stretch(high.select("chrom", "island", "piece", "start", "end", "gain", "depth", "len"), ["chrom", "island", "piece"], tile, ("depth", "len"))
    place = F.row_number().over(Window.partitionBy("chrom", "island").orderBy(F.desc("gain"), "start"))
    fits = ((F.col("len") <= short) & (F.col("place") == 1) & (size > over)) | ((F.col("len") > short) & (size > accept[0]) & (size < accept[1]))
    return found.withColumn("place", place).where(fits).select("chrom", "start", "end", F.col("depth").alias("top"), ((F.col("start") + F.col("end")) / 2.0).alias("center"))
