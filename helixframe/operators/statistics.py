"""Statistics over groups: adjusted p-values, ranks, correlations, quantile bins, empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.statistics import beta_cdf, log_beta, normal_sf
from .interval_join import same, without_keys


#: Ranges of values in which running sums are made apart.
RANGES = 64


def running(counted: DataFrame, value: str, n: str, by: list[str] | None = None) -> DataFrame:
    """counted(by, value, n), one row for each value, with _range, _upto (the sum of n up to the value) and _total.

    Values are cut into RANGES by approximate quantiles, which are one small row for each group; sums
    run within ranges and over the ranges' totals, so no group is one task. A null group is a group.
    """
    by = by or []
    g = [F.col(c).alias(f"_g_{c}") for c in by]
    edges = counted.groupBy(*g).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], F.lit(1000)).alias("_edges"))
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    joined = counted.join(edges, on) if by else counted.crossJoin(F.broadcast(edges))
    cut = joined.withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges", *[f"_g_{c}" for c in by])
    sums = cut.groupBy(*g, F.col("_range").alias("_r")).agg(F.sum(n).alias("_s"))
    w = Window.partitionBy(*[f"_g_{c}" for c in by]).orderBy("_r")
    sums = sums.select("*", (F.sum("_s").over(w) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy(*[f"_g_{c}" for c in by])).alias("_total"))
    out = cut.join(sums, [*on, F.col("_range") == F.col("_r")])
    upto = F.col("_before") + F.sum(n).over(Window.partitionBy(*by, "_range").orderBy(value))
    return out.withColumn("_upto", upto).drop("_r", "_s", "_before", *[f"_g_{c}" for c in by])


def adjust_bh(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """df with padj by Benjamini and Hochberg within groups; null p stays null and does not count.

    Ranks are counted over the distinct p-values of a group, in ranges.
    """
    by = by or []
    distinct = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n"))
    table = running(distinct, p, "_n", by).withColumn("_q", F.col(p) * F.col("_total") / F.col("_upto"))
    least = table.groupBy(*by, F.col("_range").alias("_r")).agg(F.min("_q").alias("_m"))
    later = F.min("_m").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(1, Window.unboundedFollowing))
    least = least.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_r", later.alias("_later"))
    table = table.join(least, [*[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by], F.col("_range") == F.col("_r")])
    here = F.min("_q").over(Window.partitionBy(*by, "_range").orderBy(F.desc(p)))
    table = table.select(*by, p, F.least(F.lit(1.0), here, "_later").alias("padj"))
    return without_keys(same(df, table, [*by, p], "left"), [*by, p])


def with_ranks(df: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """df with the rank of a value in its group, ties averaged, counted over the distinct values; null values get no rank."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = running(counted, value, "_n", by).select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return without_keys(same(df, ranks, [*by, value], "left"), [*by, value])


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties averaged, as a window for small groups; with_ranks() is for large ones."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def empirical_p(observed: DataFrame, null: DataFrame, key: str, value: str, less: bool = True) -> DataFrame:
    """(key, value, p): the share of null draws (key, draw) at or below (or at or above) each different observed value.

    Draws and observed values are counted, and one running sum over both replaces all pairs. Values
    of keys without draws get no p; null values and draws do not count.
    """
    zero = observed.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_own")).distinct()
    draws = null.where("draw IS NOT NULL").groupBy(key, F.col("draw").cast("double").alias("_at")).agg(F.count("*").alias("_n"))
    both = zero.unionByName(draws.withColumn("_own", F.lit(False))).groupBy(key, "_at").agg(F.sum("_n").alias("_n"), F.max("_own").alias("_own"))
    r = running(both, "_at", "_n", [key]).where(F.col("_own") & (F.col("_total") > 0))
    held = F.col("_upto") if less else F.col("_total") - F.col("_upto") + F.col("_n")
    return r.select(key, F.col("_at").cast(observed.schema[value].dataType).alias(value), (held / F.col("_total")).alias("p"))


def similarity(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson, Spearman and cosine similarity, and R2 of y as a prediction of x, within groups."""
    ranked = with_ranks(with_ranks(df.select(*by, x, y), x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(
        F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"),
        (F.sum(F.col(x) * F.col(y)) / F.sqrt(F.sum(F.col(x) * F.col(x)) * F.sum(F.col(y) * F.col(y)))).alias("cosine"),
        (1 - F.sum((F.col(x) - F.col(y)) ** 2) / (F.var_pop(x) * F.count(x))).alias("r2"),
    )


def quantile_bins(df: DataFrame, value: str, k: int, by: list[str] | None = None) -> DataFrame:
    """df with bin 0..k-1 by linearly interpolated quantile edges, right-closed; the edges are one small row per group."""
    by = by or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    r = running(counted, value, "_n", by)
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))  # noqa: E731  the value at a place from 0
    place = lambda i: (F.col("_total") - 1) * F.lit(i / k)
    cols = [x for i in range(1, k) for x in (at(F.floor(place(i))).alias(f"_lo{i}"), at(F.ceil(place(i))).alias(f"_hi{i}"))]
    low = r.groupBy(*by).agg(F.max("_total").alias("_total"), *cols)
    part = lambda i: place(i) - F.floor(place(i))
    edges = low.select(*by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(i) for i in range(1, k)]).alias("_edges"))
    joined = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))
    return joined.withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")


def beta_prior(share: Column) -> list[Column]:
    """Shape parameters of a beta distribution by the method of moments (mean and variance of the shares)."""
    m, v = F.avg(share), F.var_samp(share)
    k = m * (1 - m) / v - 1
    return [(m * k).alias("alpha0"), ((1 - m) * k).alias("beta0")]


def beta_posterior(df: DataFrame, hits: str, total: str) -> DataFrame:
    """df(hits, total, alpha0, beta0) with posterior shape, mean, log Bayes factor against a half and the share below a half."""
    a, b = F.col(hits) + F.col("alpha0"), F.col(total) - F.col(hits) + F.col("beta0")
    out = df.withColumns({"alpha1": a, "beta1": b, "posterior": a / (a + b)})
    bf = log_beta(F.col("alpha1"), F.col("beta1")) - log_beta(F.col("alpha0"), F.col("beta0")) + F.col(total) * F.ln(F.lit(2.0))
    return out.withColumns({"log_bf": bf, "below_half": beta_cdf(F.col("alpha1"), F.col("beta1"), F.lit(0.5))})


def rank_sum(df: DataFrame, value: str, group: str, first, by: list[str]) -> DataFrame:
    """(by, z, p): two-sided rank-sum test of the rows with group = first against the others, normal approximation."""
    r = with_ranks(df, value, "_r", by)
    s = r.groupBy(*by).agg(F.sum(F.when(F.col(group) == first, F.col("_r"))).alias("w"), F.count_if(F.col(group) == first).alias("n1"), F.count_if(F.col(group) != first).alias("n2"))
    mean, sd = F.col("n1") * (F.col("n1") + F.col("n2") + 1) / 2, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return s.where("n1 > 0 AND n2 > 0").withColumn("z", (F.col("w") - mean) / sd).select(*by, "z", (2 * normal_sf(F.abs("z"))).alias("p"))


def difference_over(pmf_x: DataFrame, pmf_y: DataFrame, over: float) -> DataFrame:
    """(p, odds): the chance that x - y > over for two discrete distributions (value, p), exactly; a running sum of y replaces all pairs."""
    w = Window.orderBy("at")
    both = pmf_x.select((F.col("value") - over).alias("at"), F.col("p").alias("px"), F.lit(0.0).alias("py")).union(pmf_y.select("value", F.lit(0.0), "p"))
    both = both.groupBy("at").agg(F.sum("px").alias("px"), F.sum("py").alias("py"))
    below = F.coalesce(F.sum("py").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = both.select((F.col("px") * below).alias("x")).agg(F.sum("x").alias("p"))
    return p.select("p", (F.col("p") / (1 - F.col("p"))).alias("odds"))


#: Dispersions that are tried: 0.01 to 3 by hundredths.
DISPERSIONS = 300


def fit_dispersion(moments: DataFrame, mean: str, variance: str) -> DataFrame:
    """(phi, error): the dispersion for which log(mean + phi mean^2) lies closest to log(variance), by the mean squared error over genes.

    Genes with no variance are left out; ties go to the smaller phi. The grid is fixed, so each gene
    makes a fixed number of terms, summed where they arise.
    """
    grid = F.explode(F.sequence(F.lit(1), F.lit(DISPERSIONS)))
    each = moments.where((F.col(mean) > 0) & (F.col(variance) > 0)).select(mean, variance, grid.alias("_i")).withColumn("_phi", F.col("_i") / 100.0)
    miss = F.ln(F.col(variance)) - F.ln(F.col(mean) + F.col("_phi") * F.col(mean) * F.col(mean))
    fits = each.groupBy("_phi").agg(F.avg(miss * miss).alias("_error"))
    return fits.agg(F.min(F.struct(F.round("_error", 9).alias("error"), F.col("_phi").alias("phi"))).alias("_m")).select("_m.phi", "_m.error")


def volcano(results: DataFrame, fold: str, p: str, least_fold: float = 1.0, most_p: float = 0.05) -> DataFrame:
    """results with volcano_x (log2 fold change), volcano_y (-log2 p, p of 0 as the smallest double) and significant."""
    x = F.log2(F.col(fold))
    return results.withColumns({"volcano_x": x, "volcano_y": -F.log2(F.greatest(F.col(p), F.lit(5e-324))), "significant": (F.abs(x) >= least_fold) & (F.col(p) <= most_p)})
