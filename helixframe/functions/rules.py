"""Ordered rule tables: the first pattern that matches names the class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transcript type -> class, first match wins.
RNA_TYPE_RULES = (
    ("^(Mt_)?tRNA$", "tRNA"),
    ("^(rRNA|Mt_rRNA|rDNA)$", "rRNA"),
    ("^(miRNA|snoRNA|scaRNA|snRNA|Y_RNA|vaultRNA|piRNA|7SK|7SL)$", "Other sncRNA"),
    ("repeat|Satellite|Alu|LINE|SINE", "Repeats"),
    ("^(protein_coding|IG_|TR_)", "Protein coding"),
    ("lncRNA|lincRNA|antisense|processed_transcript", "lncRNA"),
    ("RBP", "RBP"),
)
#: Sample name -> treatment; a sample may belong to several.
TREATMENTS = (("^Qcf(1|2|3|4)$", "unfragmented"), ("^Qcf([5-8])$", "fragmented"), ("^Qcf(9|1[0-2])$", "polyA"), ("^Qcf", "all"))


def classify(col: Column, rules, default: Column | str | None = "other") -> Column:
    """A when-chain over (pattern, class) rules; null in gives the default."""
    out = None
    for pattern, name in rules:
        out = F.when(col.rlike(pattern), F.lit(name)) if out is None else out.when(col.rlike(pattern), F.lit(name))
    default = F.lit(default) if not isinstance(default, Column) else default
    return default if out is None else out.otherwise(default)


def rule_join(df: DataFrame, column: str, rules, name: str) -> DataFrame:
    """Each row once for each rule that its column matches (the rule table is fixed and small)."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(rules), f"_pattern string, {name} string")
    return df.join(F.broadcast(table), F.expr(f"{column} rlike _pattern")).drop("_pattern")
