"""Queries for transcript projection, gene parts, introns, catalogues, expression, dispersion, components and scores, each rule in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence
from ..functions.statistics import log_beta
from ..operators import annotate, composite, counting, coverage, statistics
from ..operators import interval_join as ij
from .interval import _STEPS, _WIDE, LEN_A, LEN_B, ON, OV
from .registry import query

_INTRONS = """introns AS (SELECT a.chrom, a."end" AS start, b.start AS "end", a.strand, a.name FROM exons a JOIN exons b ON a.name = b.name AND b.exon_no = a.exon_no + 1 WHERE b.start > a."end")"""


def _introns(e):
    nxt = e.select("name", (F.col("exon_no") - 1).alias("exon_no"), F.col("start").alias("nxt"))
    return e.join(nxt.hint("merge"), ["name", "exon_no"]).where(F.col("nxt") > F.col("end")).select("chrom", F.col("end").alias("start"), F.col("nxt").alias("end"), "strand", "name")


@query("jn21_intervals", "exons abundance", """, x AS (SELECT *, sum("end" - start) OVER (PARTITION BY name ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END ROWS UNBOUNDED PRECEDING) AS t1, "end" - start AS size FROM exons),
 q AS (SELECT 'G' || substr(target_id, 2) AS name, target_id, CAST(eff_length // 40 AS BIGINT) AS s, CAST(eff_length // 8 AS BIGINT) AS e FROM abundance), p AS (SELECT *, s + 1 AS p, 0 AS side FROM q UNION ALL SELECT *, e, 1 FROM q),
 g AS (SELECT target_id, x.chrom, x.strand, side, CASE WHEN x.strand = '-' THEN x."end" - (p - (t1 - size)) ELSE x.start + p - (t1 - size) END AS pos FROM p JOIN x USING (name) WHERE p > t1 - size AND p <= t1)
 SELECT target_id, chrom, strand, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) AS BIGINT) AS "end" FROM g GROUP BY target_id, chrom, strand HAVING count(DISTINCT side) = 2""")
def jn21_intervals(e, a):
    """Transcript intervals on the genome, exon by exon, ends swapped on the minus strand."""
    q = a.select(F.concat(F.lit("G"), F.expr("substr(target_id, 2)")).alias("name"), "target_id", F.expr("eff_length DIV 40").alias("start"), F.expr("eff_length DIV 8").alias("end"))
    return ij.project(q, e).select("target_id", "chrom", "strand", "start", "end")


_PARTS = """, parts AS (SELECT chrom, start, "end", 'exon' AS gtype FROM exons UNION ALL SELECT chrom, start, "end", 'intron' FROM introns UNION ALL SELECT chrom, start, "end", 'processed_pseudogene' FROM annotations WHERE bio_type = 'RBP')"""


@query("ann5_genic_classes", "peaks exons annotations", f""", {_INTRONS}{_PARTS}, s AS (SELECT a.*, a.score / 50.0::DOUBLE AS psi, b.gtype, b.start AS gstart, b."end" AS gend, ({OV}) / {LEN_A} AS share, ({OV}) / {LEN_A} * (({OV}) / {LEN_B}) AS sc, row_number() OVER (PARTITION BY a.peakname ORDER BY round(({OV}) / {LEN_A} * (({OV}) / {LEN_B}), 12) DESC, b.gtype, b.start) AS k FROM peaks a JOIN parts b ON {ON}),
 w AS (SELECT *, EXISTS (SELECT 1 FROM introns i WHERE i.chrom = s.chrom AND i.start < s."end" AND i."end" > s.start AND ((i.start - 3 < gend AND gend < i.start + 3 AND i."end" > s."end") OR (i."end" - 3 < gstart AND gstart < i."end" + 3 AND i.start < s.start)) AND least(s."end", i."end") - greatest(s.start, i.start) > 10) AND share <= 0.6 AS runs_on FROM s WHERE k = 1),
 c AS (SELECT peakname, CASE WHEN gtype = 'intron' AND sc > 0.8 THEN 'Full-length intron' WHEN gtype = 'intron' AND psi < 0.1 THEN 'Within intron' WHEN gtype = 'intron' AND psi <= 0.2 THEN 'intron' WHEN gtype LIKE '%pseudo%' THEN 'Pseudogene' WHEN runs_on THEN 'Exon-intron' ELSE 'Exon' END AS class FROM w)
 SELECT peakname, coalesce(class, '.') AS class FROM peaks LEFT JOIN c USING (peakname)""")
def ann5_genic_classes(p, e, a):
    introns = _introns(e)
    part = lambda df, t: df.select("chrom", "start", "end", F.lit(t).alias("gtype"))
    parts = part(e, "exon").unionByName(part(introns, "intron")).unionByName(part(a.where("bio_type = 'RBP'"), "processed_pseudogene"))
    peaks = p.select("chrom", "start", "end", "peakname", (F.col("score") / 50.0).alias("psi"))
    return annotate.genic_classes(peaks, parts, introns.select("chrom", "start", "end")).select("peakname", "class")


_STRANDED = f"{ON} AND a.strand = b.strand"


@query("ann6_intron_flags", "peaks exons", f", {_INTRONS} SELECT a.peakname, CASE WHEN EXISTS (SELECT 1 FROM introns b WHERE {_STRANDED} AND {OV} >= 0.9 * {LEN_A} AND {OV} >= 0.9 * {LEN_B}) THEN 'Excised full-length intron' ELSE '.' END AS fulllength_intron FROM peaks a")
def ann6_intron_flags(p, e):
    return annotate.intron_flag(p, _introns(e)).select("peakname", "fulllength_intron")


_MIRTRON = f""", {_INTRONS}, known AS (SELECT b.chrom, b.start, b."end", b.strand, EXISTS (SELECT 1 FROM fragments a WHERE a.chrom = b.chrom AND a.strand = b.strand AND abs(a.start - b.start) < 5 AND abs(a."end" - b."end") < 5 AND a.start < b."end" AND b.start < a."end") AS whole FROM introns b),
 met AS (SELECT DISTINCT a.peakname, coalesce(b.whole, FALSE) AS whole FROM peaks a LEFT JOIN known b ON {_STRANDED} AND {OV} >= 0.5 * {LEN_A} AND {OV} >= 0.9 * {LEN_B})"""


@query("ann6_mirtrons_removed", "peaks exons fragments", f"{_MIRTRON} SELECT DISTINCT peakname FROM met WHERE NOT whole")
def ann6_mirtrons_removed(p, e, f):
    return annotate.mirtron_filter(p, _introns(e), f).select("peakname")


@query("ann6_mirtrons_kept", "peaks exons fragments", f"{_MIRTRON} SELECT DISTINCT peakname, CASE WHEN whole THEN 'full-length intron' ELSE '.' END AS is_intron FROM met")
def ann6_mirtrons_kept(p, e, f):
    return annotate.mirtron_filter(p, _introns(e), f, remove=False).select("peakname", "is_intron")


@query("cat1_full_catalogue", "annotations", """SELECT chrom, start, "end", split_part(gene_id || '_' || gene_name, '_', 1) AS name, size AS score, strand, 'RBP' AS bio_type, gene_id FROM annotations WHERE bio_type = 'RBP' AND size > 2
 UNION ALL SELECT chrom, start, "end", gene_name, size * 50, strand, 'piRNA', gene_name FROM annotations WHERE bio_type = 'lncRNA' AND size * 50 > 1000 UNION ALL SELECT chrom, start, "end", gene_name, size, strand, bio_type, gene_id FROM annotations WHERE regexp_matches(bio_type, 'miRNA|tRNA')""")
def cat1_full_catalogue(a):
    a = a.withColumn("score", F.col("size"))
    rbp = a.where("bio_type = 'RBP'").withColumn("name", F.concat_ws("_", "gene_id", "gene_name"))
    pi = a.where("bio_type = 'lncRNA'").withColumns({"name": F.col("gene_name"), "score": F.col("size") * 50})
    return annotate.catalogue(rbp, pi, a.withColumn("name", F.col("gene_name")), "miRNA|tRNA")


_PREPS = ("1", "2", "3", "4", "5")


@query("cnt11_expression_matrix", "abundance", """, a AS (SELECT substr(prep, 7, 1) AS prep, eff_length % 3 AS sample, target_id, tpm FROM abundance), g AS (SELECT a.prep, a.sample, b.gene_id, sum(a.tpm) AS tpm FROM a JOIN abundance b USING (target_id) GROUP BY ALL), m AS (SELECT prep, gene_id, avg(tpm) AS tpm FROM g GROUP BY ALL), t AS (SELECT prep, gene_id, tpm * 1e6 / sum(tpm) OVER (PARTITION BY prep) AS tpm FROM m)
 SELECT gene_id, """ + ", ".join(f"round(coalesce(sum(tpm) FILTER (prep = '{p}'), 0), 4) AS prep{p}" for p in _PREPS) + " FROM t GROUP BY gene_id")
def cnt11_expression_matrix(a):
    rows = a.select(F.substring("prep", 7, 1).alias("prep"), (F.col("eff_length") % 3).alias("sample"), "target_id", "tpm")
    wide = counting.expression_matrix(rows, a.select("target_id", "gene_id"), list(_PREPS))
    return wide.select("gene_id", *[F.round(p, 4).alias(f"prep{p}") for p in _PREPS])


@query("cnt16_base_composition", "sequences", ", t AS (SELECT source, regexp_extract(raw, '[GT]*$') AS t FROM sequences WHERE raw <> ''), n AS (SELECT source, t AS base, count(*) AS n FROM t WHERE length(t) = 1 GROUP BY ALL) SELECT source, base, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM n")
def cnt16_base_composition(s):
    """Single bases of G or T at the ends of whole sequences, by source."""
    tails = s.where("raw <> ''").select("source", F.regexp_extract("raw", "([GT]*)$", 1).alias("non_template"))
    return counting.base_composition(tails, "source").select("source", "base", "n", F.round("share", 6).alias("share"))


@query("st11_fitted_dispersion", "counts", """, t AS (SELECT gene_id, samplename, sum(read_count) AS n FROM counts GROUP BY ALL), m AS (SELECT avg(n) AS m, var_samp(n) AS v FROM t GROUP BY gene_id HAVING count(*) > 1), f AS (SELECT i / 100.0::DOUBLE AS phi, round(avg(power(ln(v) - ln(m + i / 100.0::DOUBLE * m * m), 2)), 9) AS error FROM m, range(1, 301) r(i) WHERE v > 0 AND m > 0 GROUP BY i)
 SELECT phi, round(error, 6) AS error FROM f ORDER BY f.error, phi LIMIT 1""")
def st11_fitted_dispersion(c):
    t = c.groupBy("gene_id", "samplename").agg(F.sum("read_count").alias("n")).groupBy("gene_id").agg(F.avg("n").alias("m"), F.var_samp("n").alias("v"), F.count("*").alias("k")).where("k > 1")
    return statistics.fit_dispersion(t, "m", "v").select("phi", F.round("error", 6).alias("error"))


@query("st12_loadings", "counts")
def st12_loadings(c):
    """What each type of gene adds to the first two principal components of the samples."""
    types = ["protein_coding", "miRNA", "tRNA", "Simple_repeat", "lncRNA"]
    wide = counting.pivot(c, ["samplename"], "gene_type", types, F.sum("read_count"))
    return composite.loadings(wide, types, 2).select("column", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("st13_volcano", "peaks", "SELECT peakname, round(log2(fc), 6) AS volcano_x, round(-log2(pow(10, -log10p / 100)), 6) AS volcano_y, abs(log2(fc)) >= 1 AND pow(10, -log10p / 100) <= 0.05 AS significant FROM peaks WHERE fc > 0")
def st13_volcano(p):
    d = p.where("fc > 0").select("peakname", "fc", F.pow(F.lit(10.0), -F.col("log10p") / 100).alias("p"))
    return statistics.volcano(d, "fc", "p").select("peakname", F.round("volcano_x", 6).alias("volcano_x"), F.round("volcano_y", 6).alias("volcano_y"), "significant")


_POST = """, t AS (SELECT gene_type, gene_id, CAST(coalesce(sum(read_count) FILTER (strand = 'sense'), 0) AS DOUBLE) AS h, CAST(sum(read_count) AS DOUBLE) AS n FROM counts GROUP BY ALL), m AS (SELECT gene_type, avg(h / n) AS m, var_samp(h / n) AS v FROM t WHERE n > 100 AND h > 0 AND h < n GROUP BY gene_type), q AS (SELECT gene_type, m * (m * (1 - m) / v - 1) AS a0, (1 - m) * (m * (1 - m) / v - 1) AS b0 FROM m),
 b AS (SELECT gene_id, t.gene_type, (h + a0) / (n + a0 + b0) AS posterior, (lgamma(h + a0) + lgamma(n - h + b0) - lgamma(n + a0 + b0)) - (lgamma(a0) + lgamma(b0) - lgamma(a0 + b0)) + n * ln(2.0) AS log_bf FROM t JOIN q USING (gene_type))"""


def _posterior(c):
    t = c.groupBy("gene_type", "gene_id").agg(F.sum(F.when(F.col("strand") == "sense", F.col("read_count")).otherwise(0)).alias("hits"), F.sum("read_count").alias("total"))
    prior = t.where("total > 100 AND hits > 0 AND hits < total").groupBy("gene_type").agg(*statistics.beta_prior(F.col("hits") / F.col("total")))
    a, b = F.col("hits") + F.col("alpha0"), F.col("total") - F.col("hits") + F.col("beta0")
    bf = log_beta(a, b) - log_beta(F.col("alpha0"), F.col("beta0")) + F.col("total") * F.ln(F.lit(2.0))
    return t.join(F.broadcast(prior), "gene_type").select("gene_type", "gene_id", (a / (a + b)).alias("posterior"), bf.alias("log_bf"))


@query("st5_bayes_factors", "counts", f"{_POST} SELECT gene_id, round(posterior, 6) AS posterior, round(log_bf, 4) AS log_bf FROM b")
def st5_bayes_factors(c):
    return _posterior(c).select("gene_id", F.round("posterior", 6).alias("posterior"), F.round("log_bf", 4).alias("log_bf"))


_TAGGED = ", s AS (SELECT raw, CASE WHEN regexp_matches(raw, '" + composite.TELOMERE + "') THEN 'Telomere' WHEN regexp_matches(raw, '" + composite.CENTROMERE + "') THEN 'Centromere' ELSE 'Tandem repeats' END AS tag FROM sequences WHERE raw IS NOT NULL)"


@query("st15_motif_tags", "sequences", f"{_TAGGED} SELECT tag, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY tag")
def st15_motif_tags(s):
    return s.where("raw IS NOT NULL").groupBy(composite.motif_tag(F.col("raw")).alias("tag")).agg(F.count("*").alias("n"))


@query("st15_classes", "counts", f"{_POST} SELECT gene_id, gene_type, CASE WHEN round(log_bf, 6) <= 3 THEN 'none' WHEN posterior > 0.5 THEN 'sense' ELSE 'antisense' END AS class, round(abs(posterior - 0.5), 6) AS delta FROM b")
def st15_classes(c):
    side = F.when(F.round("log_bf", 6) <= 3, "none").when(F.col("posterior") > 0.5, "sense").otherwise("antisense")
    return _posterior(c).select("gene_id", "gene_type", side.alias("class"), F.round(F.abs(F.col("posterior") - 0.5), 6).alias("delta"))


@query("st10_z_scores", "counts", """, t AS (SELECT gene_type, gene_id, strand, sum(read_count) AS n FROM counts GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY gene_type ORDER BY n) + (count(*) OVER (PARTITION BY gene_type, n) - 1) / 2.0 AS r FROM t), s AS (SELECT gene_type, sum(r) FILTER (strand = 'sense') AS w, count(*) FILTER (strand = 'sense') AS a, count(*) FILTER (strand <> 'sense') AS b FROM r GROUP BY gene_type)
 SELECT gene_type, round((w - a * (a + b + 1) / 2.0) / sqrt(a * b * (a + b + 1) / 12.0), 6) AS z FROM s WHERE a > 0 AND b > 0""")
def st10_z_scores(c):
    t = c.groupBy("gene_type", "gene_id", "strand").agg(F.sum("read_count").alias("n"))
    return statistics.rank_sum(t, "n", "strand", "sense", ["gene_type"]).select("gene_type", F.round("z", 6).alias("z"))


@query("str10_mirna_arms", "annotations", """, n AS (SELECT gene_id, 'hsa-' || CASE size % 3 WHEN 0 THEN 'let-' WHEN 1 THEN 'miR-' ELSE 'LET' END || CAST(size AS VARCHAR) || CASE WHEN strand = '+' THEN '-5p' ELSE '-3p' END AS name FROM annotations WHERE bio_type = 'miRNA') SELECT gene_id, upper(regexp_replace(regexp_replace(name, '^hsa-|miR-|-[35]p$', '', 'g'), '^let-?', 'LET', 'i')) AS name FROM n""")
def str10_mirna_arms(a):
    kind = F.when(F.col("size") % 3 == 0, "let-").when(F.col("size") % 3 == 1, "miR-").otherwise("LET")
    name = F.concat(F.lit("hsa-"), kind, F.col("size").cast("string"), F.when(F.col("strand") == "+", "-5p").otherwise("-3p"))
    return a.where("bio_type = 'miRNA'").select("gene_id", sequence.mirna_name(name).alias("name"))


@query("st12_sample_scores", "counts")
def st12_sample_scores(c):
    """Samples on the first two principal components of the log counts of all genes."""
    scores, _ = composite.sample_components(c, "gene_id", "samplename", "read_count", 2)
    return scores.select("samplename", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("st12_top_genes", "counts")
def st12_top_genes(c):
    """The 20 genes with the largest loadings on each of the first two components, of all genes."""
    _, load = composite.sample_components(c, "gene_id", "samplename", "read_count", 2)
    each = load.unpivot("gene_id", ["pc1", "pc2"], "component", "loading")
    top = lambda pc: each.where(F.col("component") == pc).orderBy(F.desc(F.abs("loading")), "gene_id").limit(20)
    return top("pc1").union(top("pc2")).select("component", "gene_id", F.round("loading", 6).alias("loading"))


_TABLE = f""", {_STEPS}, depth AS (SELECT peakname, max(depth) AS pileup FROM st GROUP BY peakname), many AS (SELECT a.peakname, count(DISTINCT b.sample) AS sample_count FROM peaks a JOIN fragments b ON {ON} GROUP BY a.peakname), {_WIDE}, {_INTRONS}{_PARTS},
 gs AS (SELECT a.*, a.score / 50.0::DOUBLE AS psi, b.gtype, b.start AS gstart, b."end" AS gend, ({OV}) / {LEN_A} AS share, ({OV}) / {LEN_A} * (({OV}) / {LEN_B}) AS sc, row_number() OVER (PARTITION BY a.peakname ORDER BY round(({OV}) / {LEN_A} * (({OV}) / {LEN_B}), 12) DESC, b.gtype, b.start) AS k FROM peaks a JOIN parts b ON {ON}),
 gw AS (SELECT *, EXISTS (SELECT 1 FROM introns i WHERE i.chrom = gs.chrom AND i.start < gs."end" AND i."end" > gs.start AND ((i.start - 3 < gend AND gend < i.start + 3 AND i."end" > gs."end") OR (i."end" - 3 < gstart AND gstart < i."end" + 3 AND i.start < gs.start)) AND least(gs."end", i."end") - greatest(gs.start, i.start) > 10) AND share <= 0.6 AS runs_on FROM gs WHERE k = 1),
 gc AS (SELECT peakname, CASE WHEN gtype = 'intron' AND sc > 0.8 THEN 'Full-length intron' WHEN gtype = 'intron' AND psi < 0.1 THEN 'Within intron' WHEN gtype = 'intron' AND psi <= 0.2 THEN 'intron' WHEN gtype LIKE '%pseudo%' THEN 'Pseudogene' WHEN runs_on THEN 'Exon-intron' ELSE 'Exon' END AS gtype FROM gw),
 hit AS (SELECT peakname, 'RF' || CAST(score AS VARCHAR) AS target, 1.0::DOUBLE / (1 + log10p * 5) AS evalue, fc AS score FROM peaks UNION ALL SELECT peakname, 'RX' || CAST(score AS VARCHAR), 1.0::DOUBLE / (1 + log10q * 10 + score), fc FROM peaks),
 rf AS (SELECT peakname, target AS rfam FROM (SELECT *, row_number() OVER (PARTITION BY peakname ORDER BY evalue, score DESC, target) AS k FROM hit WHERE evalue < 0.01) WHERE k = 1),
 f1 AS (SELECT p.*, pileup, sample_count, CASE WHEN EXISTS (SELECT 1 FROM introns b WHERE p.chrom = b.chrom AND p.start < b."end" AND b.start < p."end" AND p.strand = b.strand AND least(p."end", b."end") - greatest(p.start, b.start) >= 0.9 * (p."end" - p.start) AND least(p."end", b."end") - greatest(p.start, b.start) >= 0.9 * (b."end" - b.start)) THEN '{annotate.FULL_LENGTH_INTRON}' ELSE '.' END AS is_intron FROM peaks p JOIN depth USING (peakname) JOIN many USING (peakname) WHERE pileup >= 2 AND sample_count >= 2),
 f2 AS (SELECT f1.*, sense_gname, antisense_gname, CASE WHEN sense_gtype = 'RBP' AND is_intron <> '.' THEN 'full-length intron (RBP)' ELSE sense_gtype END AS sense_gtype, coalesce(gc.gtype, '.') AS gtype, coalesce(rfam, '.') AS rfam, CASE WHEN sense_gname <> '.' THEN 'Sense' WHEN antisense_gname <> '.' THEN 'Antisense' ELSE 'Unannotated' END AS is_sense FROM f1 JOIN t USING (peakname) LEFT JOIN gc USING (peakname) LEFT JOIN rf USING (peakname))
 SELECT chrom || ':' || CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR) AS peak_name, peakname, is_sense, CASE WHEN sense_gname <> '.' THEN sense_gname ELSE antisense_gname END AS gname, sense_gtype, strand, pileup AS fragment_count, sample_count, rfam, is_intron, gtype, EXISTS (SELECT 1 FROM annotations b WHERE b.bio_type = 'tRNA' AND b.chrom = f2.chrom AND b.start < f2."end" AND f2.start < b."end" AND b.strand = f2.strand) AS is_trna
 FROM f2 WHERE sense_gtype NOT IN ('RBP', 'Simple_repeat') AND """


def _characterised(p, a, e, f):
    """Peaks with their depth and samples through the whole chain; hits are two for each peak, made of its scores."""
    n = coverage.distinct_covering(p, f, ["peakname"], "sample")
    peaks = p.withColumn("psi", F.col("score") / 50.0).join(coverage.pileup(p, f, ["peakname"], wide=False), "peakname").join(n, "peakname")
    hit = lambda tag, evalue: p.select("peakname", F.concat(F.lit(tag), F.col("score").cast("string")).alias("target"), (1 / evalue).alias("evalue"), F.col("fc").alias("score"))
    hits = hit("RF", 1 + F.col("log10p") * 5).union(hit("RX", 1 + F.col("log10q") * 10 + F.col("score")))
    introns = _introns(e)
    part = lambda df, t: df.select("chrom", "start", "end", F.lit(t).alias("gtype"))
    parts = part(e, "exon").unionByName(part(introns, "intron")).unionByName(part(a.where("bio_type = 'RBP'"), "processed_pseudogene"))
    return annotate.supplementary(peaks, hits, a, parts, introns.select("chrom", "start", "end", "strand"), {"is_trna": a.where("bio_type = 'tRNA'")}, least=2)


@query("ann7_characterised", "peaks annotations exons fragments", f"{_TABLE} NOT (is_sense = 'Sense' AND gtype = 'Exon')")
def ann7_characterised(p, a, e, f):
    return _characterised(p, a, e, f)


@query("udf2_top_samples", "counts", """, n AS (SELECT gene_id, samplename, CAST(sum(read_count) AS BIGINT) AS n FROM counts GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY gene_id ORDER BY n DESC, samplename ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY gene_id) AS total, row_number() OVER (PARTITION BY gene_id ORDER BY n DESC, samplename) AS place FROM n)
 SELECT gene_id, samplename, n, CAST(place AS BIGINT) AS place FROM c WHERE 2 * before < total""")
def udf2_top_samples(c):
    """A caller's function of each gene's samples, of which there are few: those that hold half of its reads or more, the largest first."""

    def top(rows):
        rows = rows.sort_values(["gene_id", "n", "samplename"], ascending=[True, False, True])
        n = rows.groupby("gene_id", dropna=False, sort=False)["n"]
        rows["place"] = n.cumcount() + 1
        return rows[2 * (n.cumsum() - rows["n"]) < n.transform("sum")]

    n = c.groupBy("gene_id", "samplename").agg(F.sum("read_count").alias("n"))
    return composite.whole_groups(n, ["gene_id"], top, "samplename string, n long, place long")


@query("udf4_aligned_blocks", "fragments", """, f AS (SELECT row_number() OVER () AS r, name, start, cigar FROM fragments), t AS (SELECT r, name, start, unnest(regexp_extract_all(cigar, '[0-9]+[A-Z]')) AS tok, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z]'), 1) AS i FROM f), s AS (SELECT r, name, start, i, right(tok, 1) AS op, CAST(left(tok, length(tok) - 1) AS BIGINT) AS n FROM t),
 p AS (SELECT *, start + sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM s) SELECT name, CAST(upto - n AS BIGINT) AS block_start, CAST(upto AS BIGINT) AS block_end FROM p WHERE op = 'M'""")
def udf4_aligned_blocks(f):
    """A caller's generator: the places on the reference of each alignment's aligned stretches."""

    def blocks(start, cigar):
        n = 0
        for c in cigar:
            if c.isdigit():
                n = n * 10 + int(c)
                continue
            if c == "M":
                yield start, start + n
            start, n = start + (n if c in "MDN" else 0), 0

    return composite.expand(f, ["start", "cigar"], blocks, "block_start long, block_end long", ["name"])
