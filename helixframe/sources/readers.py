"""Readers of the text formats of sequencing tools. All go through Spark's own readers, so paths may lie in any store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import RANGE, read_ranges

BED3 = "chrom string, start long, end long"
BED6 = BED3 + ", name string, score double, strand string"
BED8 = BED6 + ", bio_type string, gene_id string"
NARROW_PEAK = BED3 + ", peakname string, score double, strand string, fc double, log10p double, log10q double, peak_summit long"
BLAST6 = "qseqid string, qlen int, sseqid string, slen int, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double"
ABUNDANCE = "target_id string, length double, eff_length double, est_counts double, tpm double"
BEDGRAPH = BED3 + ", value double"
TBLOUT = ("target", "target_accession", "query", "query_accession", "model", "model_from", "model_to", "seq_from", "seq_to", "strand", "truncated", "pass", "gc", "bias", "score", "evalue", "inclusion", "description")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False, comment: str | None = None, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """Tab-separated text by a positional schema; with a header the names come from the schema as well."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.select(*columns) if columns else df


def read_bed(spark: SparkSession, path: str, fields: int = 6, columns: list[str] | None = None) -> DataFrame:
    return read_tsv(spark, path, {3: BED3, 6: BED6, 8: BED8}[fields], columns=columns)


def read_narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, NARROW_PEAK)


def read_blast6(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, BLAST6)


def read_abundance(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ABUNDANCE, header=True)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Track lines, browser lines and comments are left out; contigs may have any name."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(track|browser)(\s|$)|^#|^\s*$"))
    at = F.split("value", r"\s+")
    return lines.select(at[0].alias("chrom"), at[1].cast("long").alias("start"), at[2].cast("long").alias("end"), at[3].cast("double").alias("value"))


def read_vcf_points(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos): the places of a variant file, 0-based."""
    return read_tsv(spark, path, "chrom string, pos long, id string, ref string, alt string", comment="#").select("chrom", (F.col("pos") - 1).alias("pos"))


def read_with_path(spark: SparkSession, glob: str, schema: str, fields: dict[str, str], **options) -> DataFrame:
    """Many files as one table, with columns drawn from each file's path by patterns (group 1)."""
    reader = spark.read.schema(schema).option("sep", "\t").options(**options)
    path = F.col("_metadata.file_path")
    return reader.csv(glob).select("*", *[F.regexp_extract(path, p, 1).alias(n) for n, p in fields.items()])


def attribute(col: Column, key: str) -> Column:
    """A value of GTF attributes `key "value";`, null if absent."""
    return F.nullif(F.regexp_extract(col, rf'(?:^|[;\s]){key} "([^"]+)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str, feature: str, keys: tuple[str, ...] = ("gene_id", "gene_name", "gene_type"), shift: int = 0) -> DataFrame:
    """Features of one kind (gene, transcript, exon) with attributes as columns; shift is added to the start (-1: 0-based)."""
    raw = read_tsv(spark, path, "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string", comment="#")
    return raw.where(F.col("feature") == feature).select("chrom", (F.col("start") + shift).alias("start"), "end", *[attribute(F.col("attributes"), k).alias(k) for k in keys], "strand")


def read_gff3(spark: SparkSession, path: str, feature: str = "gene", keys: tuple[str, ...] = ("ID", "Name", "gene_biotype")) -> DataFrame:
    """Features of one kind with `key=value` attributes as columns, starts 0-based."""
    raw = read_tsv(spark, path, "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string", comment="#")
    found = raw.where(F.col("feature") == feature).withColumn("_a", F.str_to_map("attributes", F.lit(";"), F.lit("=")))
    return found.select("chrom", (F.col("start") - 1).alias("start"), "end", *[F.try_element_at("_a", F.lit(k)).alias(k) for k in keys], "strand")


def _list(col: str) -> Column:
    return F.transform(F.filter(F.split(col, ","), lambda x: x != ""), lambda x: x.cast("long"))


def read_gene_pred(spark: SparkSession, path: str, repeated_id: bool = False) -> DataFrame:
    """Transcripts with exon starts and ends as arrays (refFlat repeats the id in front)."""
    schema = ("gene string, " if repeated_id else "") + "tid string, chrom string, strand string, tss long, tes long, cds_start long, cds_end long, exon_count int, starts string, ends string"
    return read_tsv(spark, path, schema).withColumns({"exon_starts": _list("starts"), "exon_ends": _list("ends")}).drop("starts", "ends")


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    raw = read_tsv(spark, path, BED6 + ", thick_start long, thick_end long, rgb string, exon_count int, sizes string, offsets string")
    raw = raw.withColumns({"_s": _list("sizes"), "_o": _list("offsets")})
    starts = F.transform("_o", lambda o: o + F.col("start"))
    return raw.withColumn("exon_starts", starts).withColumn("exon_ends", F.zip_with("exon_starts", "_s", lambda s, n: s + n)).drop("sizes", "offsets", "_s", "_o")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq) of each record, a record a row; a `>` counts at a line's start only. ranges.read_fasta_chunks() is for sequences too long for a row."""
    rows = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "").select(F.regexp_replace("value", "^>", "").alias("value"))
    head, body = F.regexp_extract("value", r"^([^\r\n]*)", 1), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    return rows.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("seq"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: the first eleven fields and the tags as one string; pos stays 1-based."""
    f = F.split("value", "\t", 12)
    names = (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"), ("tags", "string"))
    return spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(*[F.try_element_at(f, F.lit(i)).cast(t).alias(n) for i, (n, t) in enumerate(names, 1)])


def read_fastq(spark: SparkSession, path: str, mate: int, size: int = RANGE) -> DataFrame:
    """(read_id, mate, seq, qual) of four-line records, a file in ranges of so many bytes (a compressed one as a whole)."""
    rec = read_ranges(spark, path, "fastq", size)
    return rec.select(F.regexp_extract("head", r"^(\S+?)(/[12])?(\s|$)", 1).alias("read_id"), F.lit(mate).alias("mate"), "seq", "qual")


def read_pairs(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    """Both mates of a read on one row."""
    one, two = read_fastq(spark, path1, 1), read_fastq(spark, path2, 2)
    return one.select("read_id", F.col("seq").alias("seq1"), F.col("qual").alias("qual1")).join(two.select("read_id", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "read_id")


def read_tblout(spark: SparkSession, path: str) -> DataFrame:
    """Hit table with fields between runs of white space; comment lines skipped, the last field keeps its spaces."""
    f = F.split(F.trim("value"), r"\s+", len(TBLOUT))
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    kinds = {"model_from": "int", "model_to": "int", "seq_from": "long", "seq_to": "long", "gc": "double", "bias": "double", "score": "double", "evalue": "double"}
    return rows.select(*[F.try_element_at(f, F.lit(i)).cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(TBLOUT, 1)])


def read_trnascan(spark: SparkSession, path: str) -> DataFrame:
    """Records between blank lines: tRNA, its anticodon and where it lies, amino acid and sequence."""
    r = spark.read.text(path, lineSep="\n\n").where(F.trim("value") != "").select(F.trim("value").alias("value"))
    get = lambda p, i=1: F.regexp_extract("value", p, i)
    return r.select(get(r"^(\S+)").alias("trna"), get(r"Type:\s*(\S+)").alias("aa"), get(r"Anticodon:\s*(\S+)").alias("anticodon"), get(r"Anticodon:\s*\S+\s+at\s+(\d+)-(\d+)").cast("int").alias("anticodon_start"), get(r"Anticodon:\s*\S+\s+at\s+(\d+)-(\d+)", 2).cast("int").alias("anticodon_end"), get(r"Seq:\s*(\S+)").alias("seq"))


def read_metrics(spark: SparkSession, path: str, skip: int = 6) -> DataFrame:
    """(file, variable, value): the header and the one row after skip lines of each metrics file."""
    two = read_ranges(spark, path, "lines").where(F.col("line").isin(skip + 1, skip + 2))
    row = lambda n: F.max(F.when(F.col("line") == n, F.split("value", "\t")))
    wide = two.groupBy(F.col("path").alias("file")).agg(row(skip + 1).alias("names"), row(skip + 2).alias("values"))
    return wide.select("file", F.inline(F.arrays_zip(F.col("names").alias("variable"), F.col("values").alias("value"))))


def read_trf_reference(spark: SparkSession, path: str, schema: str, keep: str, skip: int = 6, size: int = RANGE) -> DataFrame:
    """(id, variable, value): a fragment reference without its first lines and `<` rows, columns chosen by a pattern, melted, nulls dropped."""
    names = [x.split()[0] for x in schema.split(",")]
    lines = read_ranges(spark, path, "lines", size)
    f = F.split("value", "\t")
    rows = lines.where((F.coalesce("line", F.lit(skip + 1)) > skip) & ~F.col("value").startswith("<")).select(*[F.nullif(F.try_element_at(f, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names, 1)])
    import re

    kept = [n for n in names[1:] if re.search(keep, n)]
    return rows.unpivot(names[0], kept, "variable", "value").where("value IS NOT NULL")


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def coordinates(col: Column) -> list[Column]:
    """chrom, start, end and strand out of `chr1:10-20+` (strand optional)."""
    p = r"(?:chr)?([0-9XYM]+):(\d+)-(\d+)([+-]?)"
    return [F.concat(F.lit("chr"), F.regexp_extract(col, p, 1)).alias("chrom"), F.regexp_extract(col, p, 2).cast("long").alias("start"), F.regexp_extract(col, p, 3).cast("long").alias("end"), F.nullif(F.regexp_extract(col, p, 4), F.lit("")).alias("strand")]
