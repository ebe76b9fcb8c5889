"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, label): the smallest node that each node of links(a, b) reaches.

    Every step is a shuffle of the link table with partial minima; nothing is collected but the
    number of changed links. Self links are allowed, nulls are dropped, an empty table gives none.
    """
    edges = stage(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), f"{name}-cc")
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour (or itself)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-cc")
        large = both.where("v > u").join(low, "u").selectExpr("m AS a", "v AS b").where("a <> b").distinct()
        large = stage(large, f"{name}-cc")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = stage(large.groupBy("b").agg(F.min("a").alias("m")), f"{name}-cc")
        joined = large.join(least, "b")
        small = joined.selectExpr("m AS a", "a AS b").where("a <> b").union(joined.selectExpr("m AS a", "b"))
        new = stage(small.distinct(), f"{name}-cc")
        # every node hangs on exactly one smaller node that hangs on none: done
        roots = new.select("a").distinct().join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        many = new.groupBy("b").count().where("count > 1").limit(1).count()
        edges = new
        if not roots and not many:
            return edges.selectExpr("b AS node", "a AS label").union(edges.selectExpr("a AS node", "a AS label").distinct())
