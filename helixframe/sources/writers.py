"""Writers of interval, sequence and coverage text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, header: bool = False, partitions: int | None = None, compression: str = "gzip") -> None:
    """Tab-separated text in coordinate order over all part files."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, "chrom", "start").sortWithinPartitions("chrom", "start", "end").write.option("sep", "\t").option("header", header).option("compression", compression).csv(path)


def write_split(df: DataFrame, path: str, key: str) -> None:
    """One folder for each value of key."""
    df.write.partitionBy(key).option("sep", "\t").csv(path)


def write_classes(df: DataFrame, path: str, classes: dict[str, str]) -> None:
    """Overlapping classes (name -> condition) in one pass: a row goes to each class it is in."""
    names = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in classes.items()]))
    write_split(df.withColumn("class", F.explode(names)), path, "class")


def write_fasta(df: DataFrame, path: str, name: str = "id", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), seq)).write.text(path)


def write_bedgraph(runs: DataFrame, path: str, value: str = "depth") -> None:
    write_sorted(runs.select("chrom", "start", "end", value), path, compression="none")
