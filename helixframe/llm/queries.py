"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hosts, html, langid, licenses, secrets, topk, whitening
from .bpe import digests, ranks
from .common import table
from .jaccard import near_duplicates
from .negatives import hard_negatives
from .sharding import shard
from .warc import lookup, write_archive


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths; each document's is source/d<doc_id div 64>/<doc_id>.txt, and LICENSE for the first doc_id of a folder."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 64).cast("string"))
    return licenses.scan(docs.select("doc_id", "text", F.concat_ws("/", "source", folder, name).alias("path")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, then looks every page's URL up in the two-level index."""
    pages = table(spark, sf_dir, "pages")
    root, directory = write_archive(pages)
    return lookup(spark, root, directory, pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no addresses; a document's host is its source."""
    return hosts.verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rules", "kept")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vec_id gets the next label, as the contract has it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_sharding": op3_sharding,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_bpe": op7_bpe,
    "op8_topk_search": op8_topk_search,
    "op9_warc": op9_warc,
    "op10_html_text": op10_html_text,
    "op11_host_rules": op11_host_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

_WORD = r"[^\x20\x09-\x0D]"
_HOST_SUMS = ", ".join(f"CAST(count(*) FILTER ({rule}) AS DOUBLE) AS {name}_f" for name, (rule, _) in hosts.RULES.items())
_HOST_MOMENTS = ", ".join(f"sum({name}_f) / sum(n) AS {name}_m, sum({name}_f * {name}_f / n) - sum({name}_f) * sum({name}_f) / sum(n) AS {name}_s" for name in hosts.RULES)
_HOST_OWN = ", ".join(f"({name}_s - (k - 1) * {name}_m * (1 - {name}_m)) / nullif({name}_m * (1 - {name}_m) * greatest(d - q / d - (k - 1), 0), 0) AS {name}_o" for name in hosts.RULES)
_HOST_WEIGHT = ", ".join(f"greatest(CASE WHEN {name}_o > 0 THEN least(1 / {name}_o - 1, d) ELSE d END, {hosts.LEAST_WEIGHT}) AS {name}_w" for name in hosts.RULES)
_HOST_FAILS = ", ".join(f"CASE WHEN ({name}_f + {name}_m * {name}_w) / (n + {name}_w) > {limit} THEN '{name}' END" for name, (_, limit) in hosts.RULES.items())

SQL: dict[str, str] = {
    "op11_host_rules": f"""
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT row, unnest(regexp_extract_all(t, '{_WORD}+')) AS w, generate_subscripts(regexp_extract_all(t, '{_WORD}+'), 1) AS i FROM t),
        g AS (SELECT row, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
        again AS (SELECT row, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
        r AS (SELECT row, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY row),
        l AS (SELECT row, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) AS n, len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS d FROM t),
        c AS (SELECT row, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY row),
        m AS (SELECT t.row, doc_id, source, coalesce(c.n, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, l.n AS n_lines, CAST(l.n - l.d AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
          FROM t LEFT JOIN c ON c.row = t.row LEFT JOIN l ON l.row = t.row LEFT JOIN r ON r.row = t.row),
        h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {_HOST_SUMS} FROM m WHERE source IS NOT NULL GROUP BY source),
        a AS (SELECT count(*) AS k, sum(n) AS d, sum(n * n) AS q, {_HOST_MOMENTS} FROM h),
        p AS (SELECT *, {_HOST_WEIGHT} FROM (SELECT *, {_HOST_OWN} FROM a)),
        v AS (SELECT source, concat_ws(',', {_HOST_FAILS}) AS host_rules FROM h CROSS JOIN p),
        f AS (SELECT *, {" OR ".join(f"({rule})" for rule in hosts.BASE.values())} AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(host_rules, '') AS host_rules, NOT base_failed AND coalesce(host_rules, '') = '' AS kept FROM f LEFT JOIN v ON f.source = v.source""",
    "op8_topk_search": """
        WITH v AS (
          SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY row, query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY row, query_id ORDER BY score DESC, vec_id) <= 20""",
    "op12_hard_negatives": """
        WITH v AS (
          SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.row <> c.row AND len(a.e) = len(c.e)
        ), p AS (
          SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5
        )
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.row, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.row = s.row AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY row_number() OVER (PARTITION BY p.row, place ORDER BY score DESC, vec_id) <= 5""",
    "op9_warc": """
        WITH p AS (
          SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f""",
}
