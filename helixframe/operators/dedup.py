"""Duplicate removal by coordinates and molecular barcodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

COORDINATES = ("chrom", "start", "end", "strand")


def dedup_exact(df: DataFrame, key: tuple[str, ...] = (*COORDINATES, "umi"), name: str = "name") -> DataFrame:
    """One row (the smallest name) and the number of rows of each key: partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in key and c != name]
    first = F.min(F.struct(name, *rest)).alias("_first")
    return df.groupBy(*key).agg(first, F.count("*").alias("copies")).select(*key, "_first.*", "copies")


@F.pandas_udf(ArrayType(StringType()))
def _clusters(umis: pd.Series) -> pd.Series:
    """For each list of barcodes the smallest barcode that chains of single mismatches reach."""

    def one(ws: list[str]) -> list[str]:
        root = {w: w for w in ws}

        def find(w):
            while root[w] != w:
                root[w] = root[root[w]]
                w = root[w]
            return w

        seen: dict[str, str] = {}
        for w in ws:
            for i in range(len(w)):
                mask = f"{w[:i]}*{w[i + 1:]}"
                x, y = find(w), find(seen.setdefault(mask, w))
                root[max(x, y)] = min(x, y)
        return [find(w) for w in ws]

    return umis.map(one)


def dedup_clustered(df: DataFrame, group: tuple[str, ...] = COORDINATES, umi: str = "umi") -> DataFrame:
    """(group, cluster, members, copies): barcodes of one place joined by chains of single mismatches.

    Single linkage, cluster = its smallest barcode. Copies are counted first, so a place holds each
    barcode once: its list is bounded by the barcodes there are, however many reads lie there.
    """
    own = df.groupBy(*group, umi).agg(F.count("*").alias("copies"))
    lists = own.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(umi, "copies"))).alias("_l"))
    lists = lists.select(*group, F.col(f"_l.{umi}").alias("_u"), F.col("_l.copies").alias("_c")).withColumn("_k", _clusters("_u"))
    rows = lists.select(*group, F.inline(F.arrays_zip(F.col("_k").alias("cluster"), F.col("_c").alias("copies"))))
    return rows.groupBy(*group, "cluster").agg(F.count("*").alias("members"), F.sum("copies").alias("copies"))


def poisson_umi(n: Column, length: int) -> Column:
    """Molecules behind n distinct barcodes of a length: -4^k ln(1 - n / 4^k); a saturated count is taken as one less."""
    space = float(4**length)
    return -space * F.ln(1 - F.least(n, F.lit(space - 1)) / space)


def mark_duplicates(df: DataFrame, five1: str, five2: str, strands: str, quality: str, name: str) -> DataFrame:
    """df with is_duplicate: all but the best (highest quality, then smallest name) of each pair of 5' ends and strands.

    The best name of each place is an aggregate that is joined back, so a hot place is no single
    task; only rows that repeat the best name are numbered, of which one is kept.
    """
    key = ["chrom", five1, five2, strands]
    best = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in key]).agg(F.min_by(name, F.struct(-F.col(quality), F.col(name))).alias("_best"))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    rows = df.join(best, on, "left").withColumn("_other", F.when(~F.col(name).eqNullSafe(F.col("_best")), F.xxhash64(name)))
    again = F.row_number().over(Window.partitionBy(*key, "_other").orderBy(F.desc(quality))) > 1
    return rows.withColumn("is_duplicate", F.col("_other").isNotNull() | again).drop("_best", "_other", *[f"_k_{c}" for c in key])
