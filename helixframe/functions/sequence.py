"""Expressions over sequences, read names and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids by three and by one letter.
AMINO_ACIDS = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "SeC": "U", "iMet": "M"}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def strip_version(col: Column) -> Column:
    """ENSG0001.12 -> ENSG0001."""
    return F.split_part(col, F.lit("."), F.lit(1))


def umi_of(name: Column) -> Column:
    """The barcode of a read name `[sample:]UMI_read`."""
    return F.split_part(F.element_at(F.split(name, ":"), -1), F.lit("_"), F.lit(1))


def sample_of(name: Column) -> Column:
    """The sample of a read name `sample:UMI_read`, null without one."""
    return F.when(F.contains(name, F.lit(":")), F.split_part(name, F.lit(":"), F.lit(1)))


def cigar_tokens(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR string."""
    sizes = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("int"))
    return F.zip_with(sizes, F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2)), lambda n, op: F.struct(n.alias("len"), op.alias("op")))


def cigar_sum(cigar: Column, ops: str) -> Column:
    """Summed length of the operations named."""
    return F.aggregate(F.filter(cigar_tokens(cigar), lambda x: x["op"].isin(*ops)), F.lit(0), lambda acc, x: acc + x["len"])


def introns(pos: Column, cigar: Column) -> Column:
    """array<struct<start, end>> of the introns of an alignment: M and D advance, N gives (p, p + len + 1) and advances."""
    start = F.struct(pos.cast("long").alias("p"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc, x):
        moved = F.when(x["op"].isin("M", "D", "N", "=", "X"), acc["p"] + x["len"]).otherwise(acc["p"])
        here = F.struct(acc["p"].alias("start"), (acc["p"] + x["len"] + 1).alias("end"))
        return F.struct(moved.alias("p"), F.when(x["op"] == "N", F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(cigar_tokens(cigar), start, step, lambda acc: acc["out"])


def mature_trna(seq: Column) -> Column:
    """Introns in lower case dropped, CCAA appended."""
    return F.concat(F.regexp_replace(seq, "[actgn]", ""), F.lit("CCAA"))


def amino_acid(col: Column) -> Column:
    pairs = [F.lit(x) for kv in AMINO_ACIDS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col)


def mirna_name(col: Column) -> Column:
    """hsa-miR-21-5p -> 21, hsa-let-7a -> LET7A without the last digit's suffix: prefixes and arms dropped, upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(col, "^hsa-|miR-|-[35]p$", ""), "(?i)^let-?", "LET"))


def fold_trim(fold: Column) -> Column:
    """Which ends of a dot-bracket string are unpaired for two bases or more."""
    five, three = fold.startswith(".."), fold.endswith("..")
    return F.when(five & three, "both").when(five, "5'").when(three, "3'").otherwise("none")


def adapter_prefix(seq: Column, adapter: str, skip: int = 6, rate: float = 0.1, least: int = 5) -> Column:
    """Length of the longest adapter suffix at a read's start (after skip barcode bases) with at most rate mismatches; 0 if under least."""
    body = F.substr(seq, F.lit(skip + 1))
    sizes = F.sequence(F.lit(len(adapter)), F.lit(least), F.lit(-1))

    def fits(n):
        suffix = F.substr(F.lit(adapter), len(adapter) - n + 1, n)
        wrong = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(suffix, i, F.lit(1)) != F.substr(body, i, F.lit(1))))
        return (F.length(body) >= n) & (wrong <= F.floor(n * rate))

    return F.coalesce(F.try_element_at(F.filter(sizes, fits), F.lit(1)), F.lit(0))
