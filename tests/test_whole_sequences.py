"""Queries without SQL over sequences read whole texts."""

from pyspark.sql import functions as F

from helixframe.plans import registry
from helixframe.plans.fixtures import fixture


def test_scores_of_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.id: r.n for r in fixture(spark, sf_dir, "whole_sequences").select("id", F.length("raw").alias("n")).collect()} == {i: len(t.lower()) for i, t in texts.items()}
    dna = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    got = {r.id: (r.seq, r.score) for r in registry.QUERIES["udf5_scores"](spark, sf_dir).collect()}
    assert max(len(s) for s, _ in got.values()) > 120
    for i, t in texts.items():
        seq = t.lower().translate(dna)
        assert got[i] == (seq, (seq.count("G") + seq.count("C")) / max(len(seq), 1))
