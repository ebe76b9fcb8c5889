"""The pipeline against its stages done one after the other in plain Python."""

import hashlib
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import classes, documents


def test_stage_names_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secret_scan", "tokens"]
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, sf_dir).columns == docs.columns
        assert f(spark, docs.limit(0), sf_dir).count() == 0


def test_run_by_brute_force(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {i: t for i, t in rows.items() if re.search(r"[^\W\d_]", t)}
    label = classes(list(kept.items()))
    kept = {i: t for i, t in kept.items() if label[i] == i}
    items = [" ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    plain = {i: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if not any(x in plain[i] for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(kept)
    untouched = [i for i, t in kept.items() if not re.search(r"(?i)passw|secret|token|key|AKIA|[0-9a-f]{16}|https?:", t)]
    assert len(untouched) > 50 and all(got[i].decoded_sha256 == hashlib.sha256(kept[i].encode()).hexdigest() for i in untouched)


def test_repeated_and_null_ids(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x y z"), (3, None)])
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").where(F.col("text").isNotNull()).collect())
    assert got == [(0, "x y z"), (1, "a b c d e f")]


@pytest.mark.parametrize("name", ["secret_scan", "near_duplicates", "decontamination", "tokens", "language"])
def test_nulls_in_every_column(spark, sf_dir, name):
    docs = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).count() == (name != "language")  # a text without letters has no language
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), sf_dir).count() == 0


def test_language_rejects_what_it_cannot_tell(spark, sf_dir):
    """The stage keeps what identify() tells with LEAST_SCORE or more, and some of these rows fall on either side."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = documents(spark, [(10**6, "ქართული ტექსტი არავინ იცის"), (10**6 + 1, "1234 5678"), (10**6 + 2, None), (10**6 + 3, "")]).withColumn("lang", F.lit(None).cast("string")).select(*docs.columns)
    both = docs.union(odd)
    told = {r.doc_id: (r.lang_pred, r.score) for r in corpus_pipeline.langid.identify(both, corpus_pipeline.langid.learn(both)).collect()}
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, sf_dir).collect()}
    assert kept == {i for i, (lang, score) in told.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
    assert not kept & {10**6 + k for k in range(4)} and len(kept) > 0.9 * docs.count()


def test_secrets_of_the_table_are_gone(spark, sf_dir):
    """After redaction no base secret is left in any text, and texts without one are untouched."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", re.I)
    found = lambda t: bool(assign.search(t or "") or re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", t or ""))
    after = {r.doc_id: r.text for r in corpus_pipeline.secret_scan(spark, docs, sf_dir).collect()}
    assert any(map(found, before.values())) and not any(map(found, after.values()))
