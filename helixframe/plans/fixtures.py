"""Sequencing-shaped inputs derived from the driver's tables, as one text for Spark and for DuckDB.

Each fixture is a base table and a select list; `{div}` is integer division. The same text gives
the same rows in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_UMI = " || ".join(f"substr('ACGT', CAST((l_partkey % 4096) {{div}} {4**i} % 4 AS INT) + 1, 1)" for i in range(6))
_ANN_START = "(p_partkey * 15485863) % 200000"

#: name -> (base table, select list, condition)
FIXTURES: dict[str, tuple[str, str, str]] = {
    "fragments": (
        "lineitem",
        f"""'chr' || CAST(l_suppkey % 22 + 1 AS VARCHAR(9)) AS chrom, (l_orderkey * 7919 + l_linenumber * 104729) % 200000 AS start,
        (l_orderkey * 7919 + l_linenumber * 104729) % 200000 + 20 + CAST(l_quantity AS BIGINT) * 2 AS "end",
        'Qcf' || CAST(l_orderkey % 12 + 1 AS VARCHAR(9)) || ':' || {_UMI} || '_' || CAST(l_orderkey AS VARCHAR(19)) || '_' || CAST(l_linenumber AS VARCHAR(9)) AS name,
        CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand, 'Qcf' || CAST(l_orderkey % 12 + 1 AS VARCHAR(9)) AS sample, {_UMI} AS umi, l_partkey AS partkey, l_linenumber AS mate,
        CASE l_partkey % 5 WHEN 0 THEN CAST(20 + CAST(l_quantity AS BIGINT) * 2 AS VARCHAR(9)) || 'M'
          WHEN 1 THEN '10M' || CAST(CAST(l_quantity AS BIGINT) * 2 AS VARCHAR(9)) || 'N10M'
          WHEN 2 THEN '3S' || CAST(17 + CAST(l_quantity AS BIGINT) * 2 AS VARCHAR(9)) || 'M5S'
          WHEN 3 THEN '8M2D' || CAST(10 + CAST(l_quantity AS BIGINT) * 2 AS VARCHAR(9)) || 'M'
          ELSE '6M2I' || CAST(14 + CAST(l_quantity AS BIGINT) * 2 AS VARCHAR(9)) || 'M4N6M' END AS cigar""",
        "TRUE",
    ),
    "annotations": (
        "part",
        f"""'chr' || CAST(p_partkey % 22 + 1 AS VARCHAR(9)) AS chrom, {_ANN_START} AS start, {_ANN_START} + p_size * 20 AS "end", p_brand || '-' || CAST(p_partkey AS VARCHAR(19)) AS gene_name,
        CASE WHEN (p_partkey {{div}} 22) % 2 = 0 THEN '+' ELSE '-' END AS strand,
        CASE substr(p_type, 1, 3) WHEN 'ECO' THEN 'protein_coding' WHEN 'SMA' THEN 'miRNA' WHEN 'MED' THEN 'Simple_repeat' WHEN 'PRO' THEN 'RBP' WHEN 'STA' THEN 'tRNA' ELSE 'lncRNA' END AS bio_type,
        'G' || CAST(p_partkey AS VARCHAR(19)) AS gene_id, p_size AS size""",
        "TRUE",
    ),
    "peaks": (
        "orders",
        """'chr' || CAST(o_custkey % 22 + 1 AS VARCHAR(9)) AS chrom, (o_orderkey * 6101) % 200000 AS start, (o_orderkey * 6101) % 200000 + 50 + (o_orderkey % 7) * 40 AS "end",
        'p.' || CASE WHEN o_orderkey % 2 = 0 THEN 'fwd' ELSE 'rvs' END || '_peak_' || CAST(o_orderkey AS VARCHAR(19)) AS peakname, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
        o_totalprice / 10000 AS fc, o_totalprice / 1000 AS log10p, o_totalprice / 2000 AS log10q, o_orderkey % 50 AS score""",
        "TRUE",
    ),
    "exons": (
        "part",
        f"""'chr' || CAST(p_partkey % 22 + 1 AS VARCHAR(9)) AS chrom, {_ANN_START} + k * p_size * 7 AS start, {_ANN_START} + k * p_size * 7 + p_size * 5 AS "end", 'G' || CAST(p_partkey AS VARCHAR(19)) AS name,
        p_size % 4 + 1 AS exon_count, CASE WHEN (p_partkey {{div}} 22) % 2 = 0 THEN '+' ELSE '-' END AS strand, k AS exon_no""",
        "TRUE",
    ),
    "dedup": (
        "lineitem",
        """'chr' || CAST(l_suppkey % 22 + 1 AS VARCHAR(9)) AS chrom, ((l_orderkey * 7919 + l_linenumber * 104729) % 200000) {div} 2000 * 2000 AS start,
        ((l_orderkey * 7919 + l_linenumber * 104729) % 200000) {div} 2000 * 2000 + 50 AS "end", CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand,
        'u' || CAST(l_partkey % 16 AS VARCHAR(9)) AS umi, 'r' || CAST(l_orderkey AS VARCHAR(19)) || '_' || CAST(l_linenumber AS VARCHAR(9)) AS name, CAST(l_extendedprice AS BIGINT) AS quality""",
        "TRUE",
    ),
    "counts": (
        "lineitem",
        """'Qcf' || CAST(l_suppkey % 12 + 1 AS VARCHAR(9)) AS samplename, CASE l_linestatus WHEN 'F' THEN 'sense' ELSE 'antisense' END AS strand, 'G' || CAST(l_partkey AS VARCHAR(19)) AS gene_id,
        CASE l_partkey % 5 WHEN 0 THEN 'protein_coding' WHEN 1 THEN 'miRNA' WHEN 2 THEN 'tRNA' WHEN 3 THEN 'Simple_repeat' ELSE 'lncRNA' END AS gene_type,
        CASE WHEN l_linenumber % 2 = 0 THEN 'dedup' ELSE 'all' END AS dedup, CAST(l_quantity AS BIGINT) AS read_count""",
        "TRUE",
    ),
    "expression": ("customer", """'G' || CAST(c_custkey % 200 AS VARCHAR(19)) AS gene, 'N' || CAST(c_nationkey AS VARCHAR(9)) AS sample, abs(c_acctbal) AS value, c_custkey AS k""", "TRUE"),
    "abundance": ("part", "'T' || CAST(p_partkey AS VARCHAR(19)) AS target_id, 'G' || CAST(p_partkey % 500 AS VARCHAR(19)) AS gene_id, p_size * 50 AS eff_length, p_retailprice AS tpm, p_brand AS prep", "TRUE"),
    "sequences": ("documents", "doc_id AS id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS raw, source, lang", "TRUE"),
    "whole_sequences": ("documents", "doc_id AS id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS raw, source, lang", "TRUE"),
}

_EXON_BASE = "(SELECT p.*, k FROM part p CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) e)"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns, where = FIXTURES[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    if name == "exons":
        df = df.selectExpr("*", "explode(array(0, 1, 2)) AS k")
    # DuckDB's cast of a double rounds to even, Spark's cuts
    columns = columns.replace("CAST(l_extendedprice AS BIGINT)", "CAST(rint(l_extendedprice) AS BIGINT)")
    text = columns.replace("{div}", "DIV").replace('"end"', "`end`").replace("VARCHAR(9)", "STRING").replace("VARCHAR(19)", "STRING")
    return df.where(where).selectExpr(*_split_top(text))


def _split_top(text: str) -> list[str]:
    """Cut a select list at its outer commas."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(text[last:i])
                last = i + 1
    return [*out, text[last:]]


def cte(*names: str) -> str:
    """A WITH clause (without the word) that defines fixtures for DuckDB."""
    parts = []
    for n in names:
        base, columns, where = FIXTURES[n]
        parts.append(f"{n} AS (SELECT {columns.replace('{div}', '//').replace('VARCHAR(9)', 'VARCHAR').replace('VARCHAR(19)', 'VARCHAR')} FROM {_EXON_BASE if n == 'exons' else base} WHERE {where})")
    return ", ".join(parts)
