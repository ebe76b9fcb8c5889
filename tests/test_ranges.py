"""Files cut into ranges anywhere give the same records as whole ones."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import composite
from helixframe.sources import ranges, readers


def reads(rng, n):
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30)))
        qual = "".join(rng.choice("@+IF#") for _ in seq)  # qualities look like headers
        out.append((f"r{i}", seq, qual))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq(spark, tmp_path, end):
    rng = random.Random(3)
    own = reads(rng, 120)
    text = "".join(f"@{i}/1 note{end}{s}{end}+{end}{q}{end}" for i, s, q in own)
    path = tmp_path / "a.fastq"
    path.write_bytes(text.encode())
    for size in (1 << 20, 97, 13):
        df = readers.read_fastq(spark, str(path), 1, size)
        assert sorted((r.read_id, r.seq, r.qual) for r in df.collect()) == sorted(own)
    assert readers.read_fastq(spark, str(path), 1, 500).rdd.getNumPartitions() > 5
    (tmp_path / "a.fastq.gz").write_bytes(gzip.compress(text.encode()))
    assert readers.read_fastq(spark, f"file://{tmp_path}/a.fastq.gz", 1, 97).count() == len(own)
    (tmp_path / "b.fastq").write_text("".join(f"@{i} 2\n{s}\n+\n{q}\n" for i, s, q in reversed(own)))
    pairs = readers.read_pairs(spark, str(path), str(tmp_path / "b.fastq")).collect()
    assert len(pairs) == len(own) and all(r.seq1 == r.seq2 for r in pairs)
    (tmp_path / "c.fastq").write_text("@x\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="4 bases and 2 qualities"):
        readers.read_fastq(spark, str(tmp_path / "c.fastq"), 1).collect()


def test_fasta(spark, tmp_path):
    rng = random.Random(4)
    own = [(f"c{i}", "".join(rng.choice("ACGTN") for _ in range(n))) for i, n in enumerate([0, 5, 1000, 3, 64, 0, 701])] + [("id1", "ACGT")]
    text = "".join(f">{n} A->G > variant\n" + "".join(f"{s[i : i + 60]}\n" for i in range(0, len(s), 60)) for n, s in own)
    (tmp_path / "x.fa").write_text(text)
    for size in (1 << 20, 200, 31, 7):
        rows = ranges.read_fasta_chunks(spark, str(tmp_path / "x.fa"), 64, size).collect()
        assert sorted((r.chrom, r.chunk, r.seq) for r in rows) == sorted((n, k // 64, s[k : k + 64]) for n, s in own for k in range(0, len(s), 64))
    assert sorted((r.id, r.description, r.seq) for r in readers.read_fasta(spark, str(tmp_path / "x.fa")).collect()) == sorted((n, "A->G > variant", s) for n, s in own)
    chunks = ranges.read_fasta_chunks(spark, str(tmp_path / "x.fa"), 100, 50)
    where = spark.createDataFrame([("c2", 90, 310, "+", "a"), ("c6", 650, 701, "+", "b")], "chrom string, start long, end long, strand string, name string")
    whole = dict(own)
    assert {r.name: r.seq for r in composite.interval_sequences(where, chunks, size=100).collect()} == {"a": whole["c2"][90:310], "b": whole["c6"][650:701]}


def test_lines(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"m{n}.txt").write_text("\n".join(["# x"] * 6 + ["A\tB", f"{n}\t2", "rest"]) + "\n")
    got = readers.read_metrics(spark, str(tmp_path)).select("variable", "value").where(F.col("variable") == "A").collect()
    assert sorted(r.value for r in got) == ["0", "1", "2"]
    trf = tmp_path / "t.tsv"
    trf.write_text("head\n" * 6 + "".join(f"t{i}\t{i}\t\tq\n" + "<gone\t1\t1\t1\n" for i in range(200)))
    one = sorted(map(tuple, readers.read_trf_reference(spark, str(trf), "id string, lib1 string, lib2 string, other string", "^lib").collect()))
    assert len(one) == 200 and one == sorted(map(tuple, readers.read_trf_reference(spark, str(trf), "id string, lib1 string, lib2 string, other string", "^lib", size=101).collect()))
    (tmp_path / "empty.fa").write_text("")
    assert ranges.read_fasta_chunks(spark, str(tmp_path / "empty.fa")).count() == 0
