"""Interval joins on half-open intervals by bins.

Both sides are spread over bins of a fixed width and joined on (chrom, bin), which Catalyst plans as
an ordinary equi-join; a pair counts only in the bin where the later of both starts, so it comes out
once. Intervals of more than WIDE bins meet the other side on a coarser level instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import written

#: Bins an interval may cover on the fine level.
WIDE = 64


def overlap(a: str = "", b: str = "b_") -> Column:
    """Bases that two joined intervals share (negative: the gap)."""
    return F.least(F.col(f"{a}end"), F.col(f"{b}end")) - F.greatest(F.col(f"{a}start"), F.col(f"{b}start"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def _spread(df: DataFrame, p: str, width: int, wide: bool, left: bool) -> DataFrame:
    start, end = F.col(f"{p}start"), F.col(f"{p}end")
    bins = lambda level, w: F.transform(F.sequence(F.floor(start / w), F.floor((end - 1) / w)), lambda i: F.struct(F.lit(level).alias("_level"), i.alias("_bin")))
    df = df.where(end > start)
    if not wide:
        return df.select("*", F.inline(bins(0, width)))
    coarse, long = width * WIDE, end - start > width * WIDE
    # short x short on level 0, short or long x long on level 1, long x short on level 2
    here = F.when(long, F.concat(bins(1, coarse), bins(2, coarse)) if left else bins(1, coarse)).otherwise(F.concat(bins(0, width), bins(1 if left else 2, coarse)))
    return df.select("*", F.inline(here))


def _on(prefix: str, width: int, wide: bool, strand: str | None, frac_a: float, frac_b: float, where: Column | None, once: bool) -> Column:
    """The condition of a join of spread intervals; once: a pair counts in one bin only."""
    start, bs = F.col("start"), F.col(f"{prefix}start")
    size = F.when(F.col("_la") == 0, width).otherwise(width * WIDE) if wide else F.lit(width)
    on = (F.col("chrom") == F.col(f"{prefix}chrom")) & (F.col("_la") == F.col("_lb")) & (F.col("_ba") == F.col("_bb"))
    if once:
        on &= F.col("_ba") == F.floor(F.greatest(start, bs) / size)
    return on & _meet(prefix, strand, frac_a, frac_b, where)


def _meet(prefix: str, strand: str | None, frac_a: float, frac_b: float, where: Column | None) -> Column:
    """Whether two intervals overlap, and all that is asked of them besides."""
    start, end, bs, be = F.col("start"), F.col("end"), F.col(f"{prefix}start"), F.col(f"{prefix}end")
    on = (start < be) & (bs < end)
    if strand:
        on &= (F.col("strand") == F.col(f"{prefix}strand")) if strand == "same" else (F.col("strand") != F.col(f"{prefix}strand"))
    if frac_a:
        on &= overlap("", prefix) >= frac_a * (end - start)
    if frac_b:
        on &= overlap("", prefix) >= frac_b * (be - bs)
    return on & where if where is not None else on


def _joined(a: DataFrame, b: DataFrame, how: str, once: bool, strand: str | None = None, frac_a: float = 0.0, frac_b: float = 0.0, where: Column | None = None, width: int = 1000, wide: bool = True, prefix: str = "b_") -> DataFrame:
    left, right = _spread(a, "", width, wide, True), _spread(prefixed(b, prefix), prefix, width, wide, False)
    left, right = left.withColumnsRenamed({"_level": "_la", "_bin": "_ba"}), right.withColumnsRenamed({"_level": "_lb", "_bin": "_bb"})
    # merge: what is spread over bins is estimated by its file, so a table that fills the driver would be broadcast
    return left.join(right.hint("merge"), _on(prefix, width, wide, strand, frac_a, frac_b, where, once), how).drop("_la", "_ba", "_lb", "_bb")


def interval_join(a: DataFrame, b: DataFrame, *, prefix: str = "b_", **flags) -> DataFrame:
    """Inner join of overlapping intervals: a's columns and b's with a prefix, and `overlap`.

    strand: None, "same" or "opposite". frac_a, frac_b: least share of either interval that the
    overlap covers. where: one more condition. Empty intervals match nothing. wide=False is for
    inputs whose intervals are known to be short; it saves the coarse level.
    """
    return _joined(a, b, "inner", True, prefix=prefix, **flags).withColumn("overlap", overlap("", prefix))


def _deciding(a: DataFrame, flags: dict) -> list[str]:
    """The columns of a that decide whether a row overlaps: rows that agree in them overlap alike, whatever their names."""
    return a.columns if flags.get("where") is not None else ["chrom", "start", "end", *(["strand"] if flags.get("strand") else [])]


def _hits(a: DataFrame, b: DataFrame, key: list[str], flags: dict) -> DataFrame:
    """The different values of key in a with an overlap, by a semi join: no pair becomes a row.

    Where nothing but the overlap decides, a meets the islands of b, which are disjoint, so a bin holds few of them however many intervals lie there.
    """
    prefix = flags.get("prefix", "b_")
    if flags.get("where") is None:
        by = ["chrom", *(["strand"] if flags.get("strand") else [])]
        b = b.select(*by, "start", "end").where(F.col("end") > F.col("start"))
        b = b.distinct() if flags.get("frac_a") or flags.get("frac_b") else _tile_islands(b, by, 50_000).select(*by, "start", "end")
    return _joined(a.select(*key), b, "left_semi", False, **{**flags, "prefix": prefix}).select(*key).distinct()


def same(x: DataFrame, y: DataFrame, key: list[str], how: str) -> DataFrame:
    """x joined to y where the key columns are the same, nulls included; y's key columns are named _k_*, see without_keys()."""
    y = y.withColumnsRenamed({c: f"_k_{c}" for c in key})
    on = None
    for c in key:
        one = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        on = one if on is None else on & one
    return x.join(y.hint("merge"), on, how)


def without_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.drop(*[f"_k_{c}" for c in key])


def interval_semi(a: DataFrame, b: DataFrame, **flags) -> DataFrame:
    """Rows of a that overlap any row of b. Rows that repeat stay as often as they are."""
    key = _deciding(a, flags)
    return same(a, _hits(a, b, key, flags), key, "left_semi")


def interval_anti(a: DataFrame, b: DataFrame | list[DataFrame], **flags) -> DataFrame:
    """Rows of a that overlap no row of b (or of any of several b)."""
    if isinstance(b, list):
        names = ["chrom", "start", "end", *(["strand"] if flags.get("strand") else [])]
        whole = b[0].select(*names)
        for x in b[1:]:
            whole = whole.unionByName(x.select(*names))
        b = whole
    key = _deciding(a, flags)
    return same(a, _hits(a, b, key, flags), key, "left_anti")


#: Of pairs(): bins that a row of a may be long on a level, bins that a row of b may cover, the factor from a level's bins to the next's, levels.
REACH, COVER, STEP, LEVELS = 4, 64, 8, 12

#: Of pairs(): rows of a for each task. What a task makes is many times what it reads, so bytes shuffled don't tell; so few different names are written as a dictionary.
ROWS = 24_000


def _level(p: str, most: int, levels: list[int]) -> Column:
    """The level of an interval's length, one of some: most bases on the first, STEP times more on each further one."""
    size = F.col(f"{p}end") - F.col(f"{p}start")
    return F.coalesce(*[F.when(size <= most * STEP**k, F.lit(k)) for k in levels[:-1]], F.lit(levels[-1]))


def _longest(df: DataFrame, p: str, most: int) -> tuple[dict[int, int], int]:
    """The most bases of an interval on each level that has any, and how many rows there are."""
    size = (F.col(f"{p}end") - F.col(f"{p}start")).alias("end")
    level = F.when(F.col("end") > 0, _level("", most, list(range(LEVELS))))
    found = df.select(size, F.lit(0).alias("start")).groupBy(level.alias("level")).agg(F.max("end").alias("most"), F.count("*").alias("rows")).collect()
    return {r["level"]: r["most"] for r in found if r["level"] is not None} or {0: 1}, sum(r["rows"] for r in found)


def _met(a: DataFrame, b: DataFrame, left: bool, strand: str | None = None, frac_a: float = 0.0, frac_b: float = 0.0, where: Column | None = None, width: int = 64, prefix: str = "b_") -> tuple[DataFrame, bool]:
    """The pairs of a and b, and whether each row of a lies in one bin only; if so and left, with a's rows that overlap nothing."""
    b = prefixed(b, prefix).where(F.col(f"{prefix}end") > F.col(f"{prefix}start"))
    longest, rows = _longest(a, "", REACH * width)
    there = sorted(_longest(b, prefix, COVER * width)[0])
    own, other = _level("", REACH * width, sorted(longest)), _level(prefix, COVER * width, there)
    # a pair meets on the higher of both levels
    up_a, up_b = ([k for k in x if k > min(y)] for x, y in ((there, longest), (sorted(longest), there)))
    levels = sorted({*longest, *there})
    one = lambda c, f: F.coalesce(*[F.when(F.col(c) == k, F.lit(f(k))) for k in levels[:-1]], F.lit(f(levels[-1])))
    size = lambda c: one(c, lambda k: width * STEP**k)
    reach = one("_lb", lambda k: max((n for j, n in longest.items() if j <= k), default=1))
    at = lambda df, x, up, c: df.withColumn(c, F.explode(F.array(x, *[F.when(x < k, F.lit(k)) for k in up]))).where(F.col(c).isNotNull()) if up else df.withColumn(c, x)
    x = at(a, own, up_a, "_la").withColumn("_ba", F.when(F.col("end") > F.col("start"), F.floor(F.col("start") / size("_la"))))
    y = at(b, other, up_b, "_lb")
    y = y.withColumn("_bb", F.explode(F.sequence(F.floor((F.col(f"{prefix}start") - reach + 1) / size("_lb")), F.floor((F.col(f"{prefix}end") - 1) / size("_lb")))))
    if len(levels) == 1:  # a constant is no key
        x, y = x.drop("_la"), y.drop("_lb")
    keys = [("chrom", f"{prefix}chrom"), *([("_la", "_lb")] if len(levels) > 1 else []), ("_ba", "_bb"), *([("strand", f"{prefix}strand")] if strand == "same" else [])]
    on = F.lit(True)
    for i, j in keys:
        on &= F.col(i) == F.col(j)
    on &= _meet(prefix, strand if strand != "same" else None, frac_a, frac_b, where)
    if up_a and up_b:
        on &= (F.col("_la") == own) | (F.col("_lb") == other)
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))
    x, y = x.repartition(tasks, *[i for i, _ in keys]), y.repartition(tasks, *[j for _, j in keys])
    # merge: see _joined
    return x.join(y.hint("merge"), on, "left" if left and not up_a else "inner").drop("_la", "_ba", "_lb", "_bb"), not up_a


def pairs(a: DataFrame, b: DataFrame, *, prefix: str = "b_", **flags) -> DataFrame:
    """As interval_join, for tables whose pairs are the result itself, so many more than their rows.

    A row of a lies in one narrow bin, that of its start, and those of b in all bins from which a row
    of a may reach them; so few other pairs are tried and a's columns are shuffled once. Rows of a bin meet nearly
    the same rows of b one after the other and tasks are counted by a's rows, not by bytes, so the result takes
    little space where it is written. Longer rows meet on levels of wider bins. The levels in use and the rows
    of a are looked up first. A bin is one task's, however many rows it has; they stream past those of b.
    """
    return _met(a, b, False, prefix=prefix, **flags)[0].withColumn("overlap", overlap("", prefix))


def interval_left(a: DataFrame, b: DataFrame, **flags) -> DataFrame:
    """As pairs(), and a's other rows once with nulls and overlap 0.

    One outer join decides as long as b has no intervals of a higher level than a. Otherwise rows of a
    lie on several levels, and a semi join of coordinates tells which have no pair.
    """
    prefix = flags.get("prefix", "b_")
    met, whole = _met(a, b, True, **flags)
    met = met.withColumn("overlap", F.when(F.col(f"{prefix}start").isNull(), F.lit(0)).otherwise(overlap("", prefix)))
    if whole:
        return met
    return met.unionByName(interval_anti(a, b, **flags).withColumn("overlap", F.lit(0).cast(met.schema["overlap"].dataType)), allowMissingColumns=True)


def by_set(sets: dict[int, DataFrame]) -> DataFrame:
    """Several interval sets as one, with their number in `filenum`."""
    out = None
    for n, df in sets.items():
        df = df.withColumn("filenum", F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def has_overlap(a: DataFrame, b: DataFrame, flag: str, label: str | None = None, **flags) -> DataFrame:
    """a with a column: whether a row overlaps b, or the smallest of b's labels (null: none)."""
    key = _deciding(a, flags)
    if label:
        # under a name of its own, as a may have a column of the label's name
        hits = least_labels(a, b.where(F.col(label).isNotNull()).withColumnRenamed(label, "_label"), key, ["_label"], **flags).withColumnRenamed("_label", flag)
    else:
        hits = _hits(a, b, key, flags).withColumn(flag, F.lit(True))
    out = without_keys(same(a, hits, key, "left"), key)
    return out if label else out.withColumn(flag, F.coalesce(flag, F.lit(False)))


def pair_class(mates: DataFrame, b: DataFrame, pair: str, **flags) -> DataFrame:
    """(pair, either, both): whether any mate, or every mate, of a pair overlaps b."""
    return has_overlap(mates, b, "_hit", **flags).groupBy(pair).agg(F.bool_or("_hit").alias("either"), F.bool_and("_hit").alias("both"))


def topmost(a: DataFrame, b: DataFrame, key: list[str], value: Column, parts: list[Column] | None = None, **flags) -> DataFrame:
    """The overlapping pairs of different rows of key in a with b that have the largest value (a number made of a's and b's columns) of their row; parts: disjoint conditions of pairs, within each of which the largest counts.

    The first join leaves one number for each row and part, kept in place as pairs arise; the second
    lets only pairs with that number through. So ties can be told by names, and no other pair is
    sorted or shuffled.
    """
    parts = parts or [F.lit(True)]
    own = a.select(*key).distinct()
    top = interval_join(own, b, **flags).groupBy(*key).agg(*[F.max(F.when(p, value)).alias(f"_top{i}") for i, p in enumerate(parts)])
    own = without_keys(same(own, top, key, "inner"), key)
    best = F.lit(False)
    for i, p in enumerate(parts):
        best = best | F.coalesce(p & (value == F.col(f"_top{i}")), F.lit(False))
    where = flags.pop("where", None)
    return interval_join(own, b, where=best if where is None else where & best, **flags).drop(*[f"_top{i}" for i in range(len(parts))])


def least_labels(a: DataFrame, b: DataFrame, key: list[str], labels: list[str], **flags) -> DataFrame:
    """Different rows of key in a with an overlap, and the smallest labels (in the order of the columns, nulls last) of the b rows that they overlap.

    Labels are numbered in order first, by ranges of them, so that what pairs leave is one number for
    each row, kept in place as they arise; a smallest text would have every pair sorted.
    """
    order = [F.col(c).asc_nulls_last() for c in labels]
    names = written(b.select(*labels).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rank", F.monotonically_increasing_id()), "labels")
    if flags.get("where") is None:
        b = b.select("chrom", "start", "end", *(["strand"] if flags.get("strand") else []), *labels)
        drop = labels
    else:
        drop = []
    b = without_keys(same(b, names, labels, "inner"), labels).drop(*drop)
    found = interval_join(a.select(*key).distinct(), b, **flags).groupBy(*key).agg(F.min("b__rank").alias("_rank"))
    return found.join(names.hint("merge"), "_rank").drop("_rank")


def best_overlap(a: DataFrame, b: DataFrame, name: str, **flags) -> DataFrame:
    """a with the name of the b row that overlaps most (ties: smallest name; none: null)."""
    key = _deciding(a, flags)
    p = flags.get("prefix", "b_")
    hits = topmost(a, b, key, overlap("", p), **flags).groupBy(*key).agg(F.min_by(f"{p}{name}", F.struct(f"{p}{name}")).alias(f"best_{name}"))
    return without_keys(same(a, hits, key, "left"), key)


def chained(runs: DataFrame, by: list[str], name: str, gap: int = 0, value: str | None = None, tile: int = 1_000_000, end: str | None = None) -> DataFrame:
    """Disjoint runs with a column: the start of the chain of runs each belongs to; end: one more column, the chain's end.

    A run goes on with the chain before it if the gap between them is at most gap (and their values
    are equal, if a value is named). Chains are followed within tiles; between tiles by one row for
    each tile, so the window over a chromosome grows with its length, not with the runs.
    """
    inner, across = Window.partitionBy(*by, "_tile").orderBy("start"), Window.partitionBy(*by).orderBy("_tile")
    # what follows a row is what comes before it backwards: a frame that ends at the last row would be read anew for each row
    inner_back, across_back = Window.partitionBy(*by, "_tile").orderBy(F.desc("start")), Window.partitionBy(*by).orderBy(F.desc("_tile"))
    before = (Window.unboundedPreceding, -1)
    v = F.col(value) if value else F.lit(0)
    runs = runs.withColumn("_tile", F.floor(F.col("start") / tile)).withColumn("_v", v)
    breaks = (F.col("start") - F.lag("end").over(inner) > gap) | (F.lag("_v").over(inner) != F.col("_v"))
    cuts = (F.lead("start").over(inner) - F.col("end") > gap) | (F.lead("_v").over(inner) != F.col("_v"))
    runs = runs.withColumns({"_first": F.row_number().over(inner) == 1, "_at": F.when(breaks, F.col("start")), **({"_till": F.when(cuts, F.col("end"))} if end else {})})
    tiles = runs.groupBy(*by, "_tile").agg(F.min("start").alias("_s"), F.max("end").alias("_e"), F.min_by("_v", "start").alias("_fv"), F.max_by("_v", "start").alias("_lv"), F.max("_at").alias("_last"), *([F.min("_till").alias("_next")] if end else []))
    new = F.lag("_e").over(across).isNull() | (F.col("_s") - F.lag("_e").over(across) > gap) | (F.lag("_lv").over(across) != F.col("_fv"))
    tiles = tiles.withColumn("_opens", F.when(new, F.col("_s"))).withColumn("_last", F.coalesce("_last", "_opens"))
    ends = []
    if end:
        tiles = tiles.withColumn("_ends", F.when(F.lead("_tile").over(across).isNull() | F.lead("_opens").over(across).isNotNull(), F.col("_e"))).withColumn("_next", F.coalesce("_next", "_ends"))
        ends = [F.coalesce("_ends", F.last("_next", ignorenulls=True).over(across_back.rowsBetween(*before))).alias("_beyond")]
    tiles = tiles.select(*by, "_tile", "_opens", F.last("_last", ignorenulls=True).over(across.rowsBetween(*before)).alias("_carry"), *ends)
    out = runs.join(tiles, [*by, "_tile"])
    at = F.when(F.col("_first"), F.col("_opens")).otherwise(F.col("_at"))
    out = out.withColumn(name, F.coalesce(F.last(at, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carry")))
    if end:
        out = out.withColumn(end, F.coalesce(F.last("_till", ignorenulls=True).over(inner_back.rowsBetween(Window.unboundedPreceding, 0)), F.col("_beyond"))).drop("_till", "_beyond")
    return out.drop("_tile", "_v", "_first", "_at", "_opens", "_carry")


def merge_intervals(df: DataFrame, stranded: bool = False, tile: int = 1_000_000, also: list[str] | None = None) -> DataFrame:
    """Overlapping and book-ended intervals as one: chrom, start, end, [strand], n; also: more columns within whose values to merge.

    Intervals are clipped to tiles of the chromosome and merged there; what meets at a tile's edge
    is chained afterwards.
    """
    by = ["chrom", *(["strand"] if stranded else []), *(also or [])]
    runs = _tile_islands(df, by, tile)
    return chained(runs, by, "_chain", tile=tile).groupBy(*by, "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).select(*by, "start", "end", "n")


def _tile_islands(df: DataFrame, by: list[str], tile: int) -> DataFrame:
    """(by, start, end, n): the islands of each tile of the chromosome, cut at its edges; n counts intervals that start in the tile."""
    first = F.floor(F.col("start") / tile)
    each = df.select(*by, "start", "end", first.alias("_own"), F.explode(F.sequence(first, F.greatest(first, F.floor((F.col("end") - 1) / tile)))).alias("_tile"))
    each = each.select(*by, "_tile", F.greatest("start", F.col("_tile") * tile).alias("start"), F.least("end", (F.col("_tile") + 1) * tile).alias("end"), (F.col("_tile") == F.col("_own")).cast("long").alias("_n"))
    each = each.groupBy(*by, "_tile", "start", "end").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*by, "_tile").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("_new", (reach.isNull() | (reach < F.col("start"))).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy(*by, "_tile", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_n").alias("n")).drop("_tile", "_island")


def project(intervals: DataFrame, exons: DataFrame, name: str = "name") -> DataFrame:
    """intervals(name, start, end, ...) in transcript coordinates to chrom, start, end, strand on the genome, by exons(name, chrom, start, end, strand).

    An interval's ends are the genomic places of its bases start + 1 and end, counted from 1 along the
    transcript, in ascending order. Exons follow each other by coordinate, on the minus strand
    backwards. Ends beyond the transcript give no row. Other columns of the intervals stay, and rows that
    repeat stay as often as they are.
    """
    minus = F.col("strand") == "-"
    size = F.col("x_end") - F.col("x_start")
    w = Window.partitionBy(name).orderBy(F.when(minus, -F.col("x_start")).otherwise(F.col("x_start"))).rowsBetween(Window.unboundedPreceding, 0)
    x = exons.select(name, "chrom", "strand", F.col("start").alias("x_start"), F.col("end").alias("x_end")).withColumn("_t1", F.sum(size).over(w)).withColumn("_t0", F.col("_t1") - size)
    rest = [c for c in intervals.columns if c not in (name, "start", "end", "chrom", "strand")]
    at = intervals.select(name, "start", "end", *rest, F.inline(F.array(F.struct(F.lit(0).alias("_side"), (F.col("start") + 1).alias("_p")), F.struct(F.lit(1).alias("_side"), F.col("end").alias("_p")))))
    met = at.join(x, name).where((F.col("_p") > F.col("_t0")) & (F.col("_p") <= F.col("_t1")))
    place = F.when(minus, F.col("x_end") - (F.col("_p") - F.col("_t0"))).otherwise(F.col("x_start") + F.col("_p") - F.col("_t0"))
    ends = met.groupBy(name, "start", "end", *rest, "chrom", "strand").agg(F.max(F.when(F.col("_side") == 0, place)).alias("_a"), F.max(F.when(F.col("_side") == 1, place)).alias("_b"), F.count_if(F.col("_side") == 0).alias("_n"))
    ends = ends.where("_a IS NOT NULL AND _b IS NOT NULL").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return ends.select(name, "chrom", F.least("_a", "_b").alias("start"), F.greatest("_a", "_b").alias("end"), "strand", *rest)
