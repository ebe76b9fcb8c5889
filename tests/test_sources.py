"""Readers and writers on small hand-made files."""

import glob
import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence
from helixframe.operators import composite
from helixframe.sources import readers, writers


@pytest.fixture()
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    return write


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_intervals(spark, put):
    bed = put("a.bed", "chr1\t1\t5\tx\t0\t+\nchr2\t3\t9\ty\t1.5\t-\n")
    assert rows(readers.read_bed(spark, bed, columns=["chrom", "end"])) == [("chr1", 5), ("chr2", 9)]
    peak = put("p.narrowPeak", "chr1\t1\t5\tp1\t3\t.\t2.5\t4\t3\t2\n")
    assert rows(readers.read_narrow_peak(spark, peak), "peakname", "fc", "peak_summit") == [("p1", 2.5, 2)]
    vcf = put("v.vcf", "##x\n#CHROM\tPOS\nchr1\t10\tid\tA\tC\n")
    assert rows(readers.read_vcf_points(spark, vcf)) == [("chr1", 9)]
    graph = put("t.bedgraph", "track type=bedGraph\nchr1\t0\t5\t2.5\n")
    assert rows(readers.read_bedgraph(spark, graph)) == [("chr1", 0, 5, 2.5)]


def test_paths_become_columns(spark, put):
    put("s/Qcf1.sense.tsv", "g1\t3\n"), put("s/Qcf2.antisense.tsv", "g2\t4\n")
    glob_ = put("s/Qcf3.sense.tsv", "g1\t5\n").replace("Qcf3.sense", "*")
    df = readers.read_with_path(spark, glob_, "gene string, n int", {"sample": r"/(Qcf\d+)\.", "strand": r"\.(\w+)\.tsv"})
    assert rows(df) == [("g1", 3, "Qcf1", "sense"), ("g1", 5, "Qcf3", "sense"), ("g2", 4, "Qcf2", "antisense")]


def test_gtf_and_gff(spark, put):
    gtf = put("a.gtf", '#!v\nchr1\tsrc\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; gene_name "N1";\nchr1\tsrc\texon\t11\t15\t.\t+\t.\tgene_id "G1";\n')
    assert rows(readers.read_gtf(spark, gtf, "gene", shift=-1)) == [("chr1", 10, 20, "G1", "N1", None, "+")]
    gff = put("a.gff", "##gff\nNC_1\ts\tgene\t5\t9\t.\t-\t.\tID=g1;Name=A\n")
    assert rows(readers.read_gff3(spark, gff)) == [("NC_1", 4, 9, "g1", "A", None, "-")]


def test_exon_lists(spark, put):
    pred = put("g.txt", "t1\tchr1\t+\t0\t50\t0\t50\t2\t0,20,\t10,50,\n")
    assert rows(readers.read_gene_pred(spark, pred), "tid", "exon_starts", "exon_ends") == [("t1", [0, 20], [10, 50])]
    flat = put("r.txt", "G\tt1\tchr1\t+\t0\t50\t0\t50\t1\t0,\t50,\n")
    assert rows(readers.read_gene_pred(spark, flat, repeated_id=True), "gene", "exon_ends") == [("G", [50])]
    bed = put("b12.bed", "chr1\t100\t200\tx\t0\t-\t100\t200\t0\t2\t10,20,\t0,80,\n")
    assert rows(readers.read_bed12(spark, bed), "exon_starts", "exon_ends") == [([100, 180], [110, 200])]


def test_sequences(spark, put, tmp_path):
    fasta = put("a.fa", ">s1 first one\nACGT\nAC\n>s2\nTTT\n")
    assert rows(readers.read_fasta(spark, fasta)) == [("s1", "first one", "ACGTAC"), ("s2", "", "TTT")]
    one, two = put("r1.fq", "@a/1\nAC\n+\nII\n@b/1\nGG\n+\n@@\n"), put("r2.fq", "@a/2\nTT\n+\nII\n@b/2\nCC\n+\nII\n")
    assert rows(readers.read_pairs(spark, one, two)) == [("a", "AC", "II", "TT", "II"), ("b", "GG", "@@", "CC", "II")]
    writers.write_fasta(readers.read_fasta(spark, fasta).coalesce(1), str(tmp_path / "out"))
    assert rows(readers.read_fasta(spark, str(tmp_path / "out")), "id", "seq") == [("s1", "ACGTAC"), ("s2", "TTT")]


def test_tool_reports(spark, put):
    sam = put("a.sam", "@HD\tVN:1\nr1\t99\tchr1\t5\t60\t3M2N4M\t=\t9\t10\tACGTACG\tIIIIIII\tNM:i:0\tXX:Z:y\n")
    assert rows(readers.read_sam(spark, sam), "qname", "flag", "pos", "cigar", "tags") == [("r1", 99, 5, "3M2N4M", "NM:i:0\tXX:Z:y")]
    hits = put("h.tbl", "#target\nT1  -  Q1 - cm 1 10 5 50 + no 1 0.5 0.0 33.1 1e-5 ! some  words\n")
    assert rows(readers.read_tblout(spark, hits), "target", "seq_from", "score", "evalue", "description") == [("T1", 5, 33.1, 1e-5, "some  words")]
    trna = put("t.ss", "chr1.trna1 (1-72)\nType: Ala\tAnticodon: AGC at 34-36 (34-36)\nSeq: GGGaaCC\n\nchr1.trna2 (1-9)\nType: Gly\tAnticodon: GCC at 3-5 (3-5)\nSeq: ACGT\n")
    assert rows(readers.read_trnascan(spark, trna)) == [("chr1.trna1", "Ala", "AGC", 34, 36, "GGGaaCC"), ("chr1.trna2", "Gly", "GCC", 3, 5, "ACGT")]
    metrics = put("m.txt", "\n".join(f"# {i}" for i in range(6)) + "\nA\tB\n1\t2\nrest\n")
    assert rows(readers.read_metrics(spark, metrics), "variable", "value") == [("A", "1"), ("B", "2")]
    trf = put("trf.txt", "x\n" * 6 + "t1\t5\t\tq\n<bad\t1\t1\t1\nt2\t\t7\tq\n")
    assert rows(readers.read_trf_reference(spark, trf, "id string, lib1 string, lib2 string, other string", "^lib")) == [("t1", "lib1", "5"), ("t2", "lib2", "7")]
    blast = put("b.txt", "q\t20\ts\t30\t99.5\t20\t0\t0\t1\t20\t5\t24\t1e-9\n")
    assert rows(readers.read_blast6(spark, blast), "qseqid", "pident", "evalue") == [("q", 99.5, 1e-9)]
    quant = put("ab.tsv", "target_id\tlength\teff_length\test_counts\ttpm\nT1\t10\t8\t3\t1.5\n")
    assert rows(readers.read_abundance(spark, quant), "target_id", "tpm") == [("T1", 1.5)]


def test_coordinates_in_text(spark):
    df = spark.createDataFrame([("chr1:10-20+",), ("X:5-9",)], "t string")
    assert rows(df.select(*readers.coordinates(F.col("t")))) == [("chr1", 10, 20, "+"), ("chrX", 5, 9, None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("chr2", 5, 9, "+", 3), ("chr1", 7, 8, "-", 1), ("chr1", 1, 3, "+", 2)], "chrom string, start long, end long, strand string, depth int")
    writers.write_sorted(df, str(tmp_path / "s"), partitions=2)
    lines = [x for f in sorted(glob.glob(f"{tmp_path}/s/part-*.gz")) for x in gzip.open(f, "rt").read().splitlines()]
    assert [x.split("\t")[:2] for x in lines] == [["chr1", "1"], ["chr1", "7"], ["chr2", "5"]]
    writers.write_bedgraph(df, str(tmp_path / "g"))
    assert len(rows(readers.read_bedgraph(spark, str(tmp_path / "g")))) == 3
    writers.write_classes(df, str(tmp_path / "c"), {"plus": "strand = '+'", "deep": "depth > 1"})
    assert len(glob.glob(f"{tmp_path}/c/class=*")) == 2
    assert spark.read.csv(str(tmp_path / "c"), sep="\t").count() == 4


def test_alignment_functions(spark):
    df = spark.createDataFrame([("3S10M5N4M2D6M1I2M7N3M",)], "cigar string")
    found = df.select(sequence.introns(F.lit(100), F.col("cigar")).alias("i"), sequence.cigar_sum(F.col("cigar"), "S").alias("s")).first()
    assert [(x.start, x.end) for x in found.i] == [(110, 116), (129, 137)] and found.s == 3
    seqs = spark.createDataFrame([("NNNNNNCGTACGTA",), ("NNNNNNTTTTTTTT",)], "s string")
    assert [r[0] for r in seqs.select(sequence.adapter_prefix(F.col("s"), "AAAACGTACGTA")).collect()] == [8, 0]


def test_terminal_mismatches_and_sequences(spark):
    b = [("r1", i, c, m, 6) for i, (c, m) in enumerate([("A", True), ("C", False), ("G", False), ("T", True), ("T", True), ("A", True)])] + [("r2", i, "A", i == 1, 3) for i in range(3)]
    df = spark.createDataFrame(b, "read_id string, seq_pos int, base string, is_mismatch boolean, length int")
    assert rows(composite.terminal_mismatches(df)) == [("r1", "TTA"), ("r2", ".")]
    chunks = spark.createDataFrame([("c", 0, "AACCG"), ("c", 1, "GTTTA")], "chrom string, chunk long, seq string")
    iv = spark.createDataFrame([("x", "c", 3, 8, "+"), ("y", "c", 0, 3, "-")], "name string, chrom string, start long, end long, strand string")
    assert rows(composite.interval_sequences(iv, chunks, size=5), "name", "seq") == [("x", "CGGTT"), ("y", "GTT")]
