"""The corpus pipeline: language ID, near duplicates, decontamination, secret scan, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, decontaminate, jaccard, langid, secrets
from helixframe.llm.common import small, stage, table

#: Score (posterior share times the share of words of which anything is known) below which a language is not told with any certainty.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with LEAST_SCORE or more; null text and text without letters go."""
    told = langid.identify(docs, langid.learn(docs))
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id, once; rows with null doc_id stay."""
    classes = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = stage(classes.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-gone")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    again = stage(classes.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    if again.limit(1).count():  # rows that repeat a doc_id: one of them stays
        once = kept.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
        kept = kept.join(small(again), "doc_id", "left_anti").select(*docs.columns).union(once)
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that tiles of a benchmark item give away. Null and empty texts leak nothing and stay, as do null and repeated doc_ids with clean texts."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in each text; every document stays, null texts as they are."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every row; null text counts as empty."""
    return bpe.digests(docs, bpe.ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("tokens", tokens)]

#: SQL cannot express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
