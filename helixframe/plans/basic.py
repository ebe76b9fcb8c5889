"""Queries for projections, filters, aggregates, windows, sorts, sets, functions and equi-joins."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, sequence
from ..operators import counting, statistics
from .registry import query

L = lambda c: c.cast("long")
CHROMS = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY", "chrM"]
SAMPLES = [f"Qcf{i}" for i in range(1, 13)]


# ------------------------------------------------------------------ filters


@query("flt1_thresholds", "peaks", "SELECT peakname, fc, log10p FROM peaks WHERE fc >= 10 AND log10p > 150 AND score >= 5")
def flt1(p):
    return p.where((F.col("fc") >= 10) & (F.col("log10p") > 150) & (F.col("score") >= 5)).select("peakname", "fc", "log10p")


@query("flt2_length", "fragments", 'SELECT name, start, "end" FROM fragments WHERE "end" - start BETWEEN 30 AND 80')
def flt2(f):
    return f.where((F.col("end") - F.col("start")).between(30, 80)).select("name", "start", "end")


@query("flt3_chromosomes", "fragments", "SELECT chrom, CAST(count(*) AS BIGINT) AS n FROM fragments WHERE chrom IN (" + ",".join(f"'{c}'" for c in CHROMS) + ") GROUP BY chrom")
def flt3(f):
    return f.where(F.col("chrom").isin(CHROMS)).groupBy("chrom").agg(F.count("*").alias("n"))


@query("flt4_strand", "fragments", "SELECT name, sample FROM fragments WHERE strand = '-'")
def flt4(f):
    return f.where("strand = '-'").select("name", "sample")


@query("flt6_regex", "annotations", "SELECT gene_id, bio_type FROM annotations WHERE regexp_matches(bio_type, 'RNA$') AND NOT regexp_matches(bio_type, '^t')")
def flt6(a):
    return a.where(F.col("bio_type").rlike("RNA$") & ~F.col("bio_type").rlike("^t")).select("gene_id", "bio_type")


FLAG = "((partkey * 37) % 4096)"


@query("flt7_flags", "fragments", f"SELECT name, CAST({FLAG} AS BIGINT) AS flag FROM fragments WHERE ({FLAG} & 2308) = 0 AND ({FLAG} & 64) <> 0")
def flt7(f):
    flag = (F.col("partkey") * 37) % 4096
    return f.withColumn("flag", flag).where((F.col("flag").bitwiseAND(F.lit(2308)) == 0) & (F.col("flag").bitwiseAND(F.lit(64)) != 0)).select("name", L(F.col("flag")).alias("flag"))


@query("flt11_denylist", "counts", "SELECT gene_id, CAST(sum(read_count) AS BIGINT) AS n FROM counts WHERE gene_id NOT IN ('G1', 'G2', 'G3') GROUP BY gene_id")
def flt11(c):
    return c.where(~F.col("gene_id").isin("G1", "G2", "G3")).groupBy("gene_id").agg(F.sum("read_count").alias("n"))


@query("flt12_fill", "expression", "SELECT k, CASE WHEN value > 5000 THEN 0.0 ELSE coalesce(value, 0.0) END AS value FROM expression")
def flt12(e):
    return e.select("k", F.when(F.col("value") > 5000, float("inf")).otherwise(F.col("value")).alias("value")).replace(float("inf"), None, "value").na.fill(0.0, "value")


@query("flt13_slop", "fragments", 'SELECT name, greatest(0, start - 20) AS start, "end" + 20 AS "end" FROM fragments')
def flt13(f):
    return f.select("name", F.greatest(F.lit(0), F.col("start") - 20).alias("start"), (F.col("end") + 20).alias("end"))


@query("flt13_junction_ends", "exons", 'SELECT name, chrom, CAST(start - 10 AS BIGINT) AS start, CAST(start + 10 AS BIGINT) AS "end" FROM exons WHERE start - 10 > 0 UNION ALL SELECT name, chrom, CAST("end" - 10 AS BIGINT), CAST("end" + 10 AS BIGINT) FROM exons WHERE start - 10 > 0')
def flt13b(e):
    around = F.array(*[F.struct(L(F.col(c) - 10).alias("start"), L(F.col(c) + 10).alias("end")) for c in ("start", "end")])
    return e.where(F.col("start") - 10 > 0).select("name", "chrom", F.inline(around))


@query("flt17_cigar_pattern", "fragments", "SELECT name, cigar FROM fragments WHERE NOT regexp_matches(cigar, '[0-9]+M[0-9]+N[0-9]+M')")
def flt17(f):
    return f.where(~F.col("cigar").rlike("[0-9]+M[0-9]+N[0-9]+M")).select("name", "cigar")


# ------------------------------------------------------------------ aggregates


@query("ag1_count", "counts", "SELECT samplename, gene_type, CAST(count(*) AS BIGINT) AS n FROM counts GROUP BY ALL")
def ag1(c):
    return c.groupBy("samplename", "gene_type").agg(F.count("*").alias("n"))


@query("ag2_summaries", "expression", "SELECT sample, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS low, max(value) AS high FROM expression GROUP BY sample")
def ag2(e):
    return e.groupBy("sample").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("ag3_distinct_umi", "fragments", "SELECT sample, CAST(count(DISTINCT umi) AS BIGINT) AS umis FROM fragments GROUP BY sample")
def ag3(f):
    return f.groupBy("sample").agg(F.countDistinct("umi").alias("umis"))


@query("ag6_concat", "annotations", "SELECT chrom, bio_type, string_agg(gene_name, ',' ORDER BY gene_name) AS names FROM annotations GROUP BY chrom, bio_type")
def ag6(a):
    return a.groupBy("chrom", "bio_type").agg(F.array_join(F.sort_array(F.collect_list("gene_name")), ",").alias("names"))


@query("ag8_ratios", "fragments", "SELECT sample, round(sum(CASE WHEN cigar LIKE '%N%' THEN 1.0 ELSE 0.0 END) / count(*), 6) AS psi, round(sum(CASE WHEN strand = '-' THEN 1.0 ELSE 0.0 END) / count(*), 6) AS antisense FROM fragments GROUP BY sample")
def ag8(f):
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return f.groupBy("sample").agg(rate(F.contains("cigar", F.lit("N"))).alias("psi"), rate(F.col("strand") == "-").alias("antisense"))


@query("ag15_two_levels", "counts", "SELECT gene_type, CAST(count(*) AS BIGINT) AS genes, CAST(sum(n) AS BIGINT) AS reads FROM (SELECT gene_type, gene_id, sum(read_count) AS n FROM counts GROUP BY ALL) GROUP BY gene_type")
def ag15(c):
    return c.groupBy("gene_type", "gene_id").agg(F.sum("read_count").alias("n")).groupBy("gene_type").agg(F.count("*").alias("genes"), F.sum("n").alias("reads"))


@query("ag16_pivot", "counts", "SELECT gene_id, " + ", ".join(f"CAST(coalesce(sum(read_count) FILTER (samplename = '{s}'), 0) AS BIGINT) AS {s}" for s in SAMPLES) + " FROM counts GROUP BY gene_id")
def ag16(c):
    return counting.pivot(c, ["gene_id"], "samplename", SAMPLES, F.sum("read_count"))


@query("ag17_melt", "peaks", "SELECT peakname, 'fc' AS variable, fc AS value FROM peaks UNION ALL SELECT peakname, 'log10p', log10p FROM peaks")
def ag17(p):
    return p.unpivot("peakname", ["fc", "log10p"], "variable", "value")


@query("ag18_distinct_first", "fragments", 'SELECT chrom, start, "end", strand, min(name) AS name FROM fragments GROUP BY ALL')
def ag18(f):
    return f.groupBy("chrom", "start", "end", "strand").agg(F.min("name").alias("name"))


@query("ag19_explode_names", "annotations", "SELECT name, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT gene_id, unnest(string_split(gene_name || '-' || bio_type, '-')) AS name FROM annotations) GROUP BY name")
def ag19(a):
    return a.select("gene_id", F.explode(F.array_distinct(F.split(F.concat_ws("-", "gene_name", "bio_type"), "-"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("ag20_library_size", "counts", "SELECT samplename, CAST(sum(read_count) AS BIGINT) AS total, round(sum(read_count) / 1e6, 6) AS millions FROM counts GROUP BY samplename")
def ag20(c):
    return c.groupBy("samplename").agg(F.sum("read_count").alias("total"), F.round(F.sum("read_count") / 1e6, 6).alias("millions"))


@query("ag21_consensus", "sequences", """, b AS (SELECT source, unnest(string_split(raw, '')) AS base, generate_subscripts(string_split(raw, ''), 1) AS i FROM sequences), c AS (SELECT source, i, base, count(*) AS n FROM b WHERE base IN ('A', 'C', 'G', 'T') GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY n DESC, base) AS k FROM c) SELECT source, regexp_replace(string_agg(base, '' ORDER BY i), 'ACA$', 'CCA') AS consensus FROM r WHERE k = 1 GROUP BY source""")
def ag21(s):
    b = s.select("source", F.posexplode(F.split("raw", "")).alias("i", "base")).where(F.col("base").isin("A", "C", "G", "T"))
    n = b.groupBy("source", "i", "base").agg(F.count("*").alias("n")).groupBy("source", "i").agg(F.min_by("base", F.struct(-F.col("n"), F.col("base"))).alias("base"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda x: x["base"]), "")
    return n.groupBy("source").agg(F.regexp_replace(whole, "ACA$", "CCA").alias("consensus"))


@query("ag23_histogram", "fragments", 'SELECT CAST(least("end" - start, 75) AS BIGINT) AS size, CAST(floor(start / 5000.0) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM fragments GROUP BY ALL')
def ag23(f):
    return f.groupBy(L(F.least(F.col("end") - F.col("start"), F.lit(75))).alias("size"), L(F.floor(F.col("start") / 5000.0)).alias("bin")).agg(F.count("*").alias("n"))


@query("ag25_describe", "expression", "SELECT sample, CAST(count(value) AS BIGINT) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, min(value) AS low, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS q2, round(quantile_cont(value, 0.75), 4) AS q3, max(value) AS high FROM expression GROUP BY sample")
def ag25(e):
    q = lambda x: F.round(F.percentile("value", F.lit(x)), 4)
    return e.groupBy("sample").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"), F.min("value").alias("low"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max("value").alias("high"))


# ------------------------------------------------------------------ windows


@query("wn1_share", "counts", "SELECT samplename, gene_type, round(100.0 * sum(read_count) / sum(sum(read_count)) OVER (PARTITION BY samplename), 6) AS percent FROM counts GROUP BY samplename, gene_type")
def wn1(c):
    t = c.groupBy("samplename", "gene_type").agg(F.sum("read_count").alias("n"))
    return t.select("samplename", "gene_type", F.round(counting.share("n", ["samplename"], 100.0), 6).alias("percent"))


_SIZES = "t AS (SELECT sample, \"end\" - start AS size, count(*) AS n FROM fragments GROUP BY ALL)"


@query("wn2_running_sum", "fragments", f", {_SIZES} SELECT sample, size, CAST(sum(n) OVER (PARTITION BY sample ORDER BY size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS below FROM t")
def wn2(f):
    t = f.groupBy("sample", (F.col("end") - F.col("start")).alias("size")).agg(F.count("*").alias("n"))
    return t.select("sample", "size", F.sum("n").over(Window.partitionBy("sample").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)).alias("below"))


@query("wn3_ecdf", "fragments", f", {_SIZES}, c AS (SELECT sample, size, sum(n) OVER (PARTITION BY sample ORDER BY size) AS s FROM t) SELECT sample, size, round(s / max(s) OVER (PARTITION BY sample), 6) AS ecdf FROM c")
def wn3(f):
    t = f.groupBy("sample", (F.col("end") - F.col("start")).alias("size")).agg(F.count("*").alias("n"))
    t = t.withColumn("s", F.sum("n").over(Window.partitionBy("sample").orderBy("size")))
    return t.select("sample", "size", F.round(F.col("s") / F.max("s").over(Window.partitionBy("sample")), 6).alias("ecdf"))


@query("wn4_min_max", "expression", "SELECT k, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM expression WINDOW w AS (PARTITION BY sample)")
def wn4(e):
    ends = e.groupBy("sample").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return e.join(ends, "sample").select("k", F.round((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")), 6).alias("scaled"))


@query("wn5_average_rank", "counts", ", t AS (SELECT samplename, gene_id, sum(read_count) AS n FROM counts GROUP BY ALL) SELECT samplename, gene_id, rank() OVER (PARTITION BY samplename ORDER BY n) + (count(*) OVER (PARTITION BY samplename, n) - 1) / 2.0 AS rank FROM t")
def wn5(c):
    t = c.groupBy("samplename", "gene_id").agg(F.sum("read_count").alias("n"))
    return t.select("samplename", "gene_id", statistics.average_rank("n", ["samplename"]).alias("rank"))


@query("wn6_best_row", "peaks", "SELECT chrom, arg_min(peakname, {'a': -fc, 'b': peakname}) AS peakname, max(fc) AS fc FROM peaks GROUP BY chrom")
def wn6(p):
    return p.groupBy("chrom").agg(F.min_by("peakname", F.struct(-F.col("fc"), F.col("peakname"))).alias("peakname"), F.max("fc").alias("fc"))


@query("wn8_numbering", "annotations", "SELECT gene_id, bio_type, CAST(dense_rank() OVER (PARTITION BY bio_type ORDER BY CAST(size AS VARCHAR)) - 1 AS BIGINT) AS code, CAST(row_number() OVER (PARTITION BY bio_type, size ORDER BY chrom, start, gene_id) AS BIGINT) AS number FROM annotations")
def wn8(a):
    code = F.dense_rank().over(Window.partitionBy("bio_type").orderBy(F.col("size").cast("string"))) - 1
    number = F.row_number().over(Window.partitionBy("bio_type", "size").orderBy("chrom", "start", "gene_id"))
    return a.select("gene_id", "bio_type", L(code).alias("code"), L(number).alias("number"))


@query("wn9_quantile_bins", "expression", ", q AS (SELECT sample, quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM expression GROUP BY sample) SELECT k, CAST((value > e[1])::INT + (value > e[2])::INT + (value > e[3])::INT AS BIGINT) AS bin FROM expression JOIN q USING (sample)")
def wn9(e):
    return statistics.quantile_bins(e, "value", 4, ["sample"]).select("k", L(F.col("bin")).alias("bin"))


@query("wn10_label_numbers", "counts", ", t AS (SELECT DISTINCT samplename, CASE WHEN CAST(substr(samplename, 4) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS prep FROM counts) SELECT samplename, prep || ' ' || CAST(row_number() OVER (PARTITION BY prep ORDER BY samplename) AS VARCHAR) AS label FROM t")
def wn10(c):
    t = c.select("samplename").distinct().withColumn("prep", F.when(F.substring("samplename", 4, 9).cast("int") % 2 == 0, "even").otherwise("odd"))
    return t.select("samplename", F.concat_ws(" ", "prep", F.row_number().over(Window.partitionBy("prep").orderBy("samplename")).cast("string")).alias("label"))


@query("wn11_exon_offsets", "exons", ', t AS (SELECT name, exon_no, "end" - start AS size FROM exons), s AS (SELECT *, sum(size) OVER (PARTITION BY name ORDER BY exon_no ROWS UNBOUNDED PRECEDING) AS stop, lead(size) OVER (PARTITION BY name ORDER BY exon_no) AS nxt FROM t) SELECT name, CAST(exon_no AS BIGINT) AS exon_no, CAST(stop - 1 AS BIGINT) AS junction_start, CAST(stop + 1 AS BIGINT) AS junction_end FROM s WHERE nxt IS NOT NULL')
def wn11(e):
    w = Window.partitionBy("name").orderBy("exon_no")
    t = e.select("name", "exon_no", F.sum(F.col("end") - F.col("start")).over(w).alias("stop"), F.lead("start").over(w).alias("nxt"))
    return t.where("nxt IS NOT NULL").select("name", L(F.col("exon_no")).alias("exon_no"), L(F.col("stop") - 1).alias("junction_start"), L(F.col("stop") + 1).alias("junction_end"))


@query("wn12_parity", "counts", ", t AS (SELECT DISTINCT samplename FROM counts) SELECT samplename, CAST((row_number() OVER (ORDER BY samplename) - 1) % 2 AS BIGINT) AS half FROM t")
def wn12(c):
    return c.select("samplename").distinct().select("samplename", L((F.row_number().over(Window.orderBy("samplename")) - 1) % 2).alias("half"))


# ------------------------------------------------------------------ order and sets


@query("so1_coordinates", "peaks", 'SELECT chrom, start, "end", strand, peakname FROM peaks ORDER BY chrom, start, "end", strand, peakname')
def so1(p):
    return p.select("chrom", "start", "end", "strand", "peakname").orderBy("chrom", "start", "end", "strand", "peakname")


@query("so3_top", "peaks", "SELECT peakname, fc FROM peaks ORDER BY fc DESC, peakname LIMIT 25")
def so3(p):
    return p.select("peakname", "fc").orderBy(F.desc("fc"), "peakname").limit(25)


@query("so4_top_per_group", "counts", ", t AS (SELECT gene_type, gene_id, CAST(sum(read_count) AS BIGINT) AS n FROM counts GROUP BY ALL) SELECT gene_type, gene_id, n FROM t QUALIFY row_number() OVER (PARTITION BY gene_type ORDER BY n DESC, gene_id) <= 5")
def so4(c):
    t = c.groupBy("gene_type", "gene_id").agg(F.sum("read_count").alias("n"))
    w = Window.partitionBy("gene_type").orderBy(F.desc("n"), "gene_id")
    return t.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@query("so5_given_order", "counts", ", o(place, gene_type) AS (VALUES (1, 'tRNA'), (2, 'miRNA'), (3, 'rRNA'), (4, 'protein_coding')), t AS (SELECT gene_type, CAST(sum(read_count) AS BIGINT) AS n FROM counts GROUP BY gene_type) SELECT CAST(place AS INT) AS place, gene_type, n FROM o LEFT JOIN t USING (gene_type)")
def so5(c):
    o = c.sparkSession.createDataFrame([(1, "tRNA"), (2, "miRNA"), (3, "rRNA"), (4, "protein_coding")], "place int, gene_type string")
    return o.join(c.groupBy("gene_type").agg(F.sum("read_count").alias("n")), "gene_type", "left").select("place", "gene_type", "n")


@query("se1_union", "peaks annotations", 'SELECT chrom, start, "end", peakname AS name FROM peaks UNION ALL SELECT chrom, start, "end", gene_id FROM annotations')
def se1(p, a):
    return p.select("chrom", "start", "end", F.col("peakname").alias("name")).unionByName(a.select("chrom", "start", "end", F.col("gene_id").alias("name")))


@query("se2_union_shapes", "peaks annotations", "SELECT chrom, start, peakname, NULL::VARCHAR AS gene_id FROM peaks UNION ALL SELECT chrom, start, NULL, gene_id FROM annotations")
def se2(p, a):
    return p.select("chrom", "start", "peakname").unionByName(a.select("chrom", "start", "gene_id"), allowMissingColumns=True)


@query("se3_union_distinct", "fragments annotations", "SELECT chrom, strand FROM fragments UNION SELECT chrom, strand FROM annotations")
def se3(f, a):
    return f.select("chrom", "strand").union(a.select("chrom", "strand")).distinct()


@query("se4_exclude_ids", "fragments counts", "SELECT name FROM fragments WHERE 'G' || CAST(partkey AS VARCHAR) NOT IN (SELECT gene_id FROM counts WHERE read_count = 50)")
def se4(f, c):
    return f.withColumn("gene_id", F.concat(F.lit("G"), F.col("partkey").cast("string"))).join(c.where("read_count = 50").select("gene_id"), "gene_id", "left_anti").select("name")


@query("se5_distinct_sequences", "sequences", "SELECT raw AS seq, min(id) AS id FROM sequences GROUP BY raw")
def se5(s):
    return s.groupBy(F.col("raw").alias("seq")).agg(F.min("id").alias("id"))


@query("se6_memberships", "counts", ", t AS (SELECT gene_id, " + ", ".join(f"max(CASE WHEN samplename = '{s}' THEN 1 ELSE 0 END) AS {s}" for s in SAMPLES) + " FROM counts GROUP BY gene_id) SELECT " + ", ".join(SAMPLES) + ", CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ALL")
def se6(c):
    t = c.groupBy("gene_id").agg(*[F.max(F.when(F.col("samplename") == s, 1).otherwise(0)).alias(s) for s in SAMPLES])
    return t.groupBy(*SAMPLES).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ functions


@query("str1_reverse_complement", "sequences", "SELECT id, reverse(translate(raw, 'ACGTacgt', 'TGCAtgca')) AS rc FROM sequences")
def str1(s):
    return s.select("id", sequence.reverse_complement(F.col("raw")).alias("rc"))


@query("str2_name_parts", "fragments", "SELECT name, split_part(name, ':', 1) AS sample, split_part(split_part(name, ':', 2), '_', 1) AS umi FROM fragments")
def str2(f):
    return f.select("name", sequence.sample_of(F.col("name")).alias("sample"), sequence.umi_of(F.col("name")).alias("umi"))


@query("str3_regex", "annotations", "SELECT gene_id, regexp_extract(gene_name, '#([0-9]+)-', 1) AS brand, regexp_replace(gene_name, '-[0-9]+$', '') AS stem FROM annotations")
def str3(a):
    return a.select("gene_id", F.regexp_extract("gene_name", "#([0-9]+)-", 1).alias("brand"), F.regexp_replace("gene_name", "-[0-9]+$", "").alias("stem"))


def _case(col, table, default):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for p, n in table) + f" ELSE '{default}' END"


@query("str4_rule_cascade", "annotations", f"SELECT gene_id, {_case('bio_type', rules.RNA_TYPE_RULES, 'other')} AS rna FROM annotations")
def str4(a):
    return a.select("gene_id", rules.classify(F.col("bio_type"), rules.RNA_TYPE_RULES).alias("rna"))


def _ops(op):
    return f"CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+){op}', 1), lambda x: CAST(x AS INT))), 0) AS INT)"


@query("str5_cigar_sums", "fragments", f"SELECT name, {_ops('S')} AS clipped, {_ops('[MS]')} AS bases, {_ops('N')} AS skipped FROM fragments")
def str5(f):
    s = lambda ops: sequence.cigar_sum(F.col("cigar"), ops)
    return f.select("name", s("S").alias("clipped"), s("MS").alias("bases"), s("N").alias("skipped"))


@query("flt9_clip_share", "fragments", f"SELECT name FROM fragments WHERE {_ops('S')} / {_ops('[MS]')} < 0.2")
def flt9(f):
    return f.where(sequence.cigar_sum(F.col("cigar"), "S") / sequence.cigar_sum(F.col("cigar"), "MS") < 0.2).select("name")


@query("str6_introns", "fragments", """, t AS (SELECT chrom, strand, CASE partkey % 5 WHEN 1 THEN start + 10 ELSE start + 6 + CAST(regexp_extract(cigar, 'I([0-9]+)M', 1) AS BIGINT) END AS s, CAST(regexp_extract(cigar, '([0-9]+)N', 1) AS BIGINT) AS n FROM fragments WHERE cigar LIKE '%N%')
 SELECT chrom || ':' || CAST(s AS VARCHAR) || '-' || CAST(s + n + 1 AS VARCHAR) || '_' || strand AS junction, CAST(count(*) AS BIGINT) AS reads FROM t GROUP BY 1""")
def str6(f):
    j = f.select("chrom", "strand", "name", F.inline(F.array_distinct(sequence.introns(F.col("start"), F.col("cigar")))))
    key = F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("_"), F.col("strand"))
    return j.groupBy(key.alias("junction")).agg(F.count("*").alias("reads"))


@query("str7_substring", "sequences", "SELECT id, substr(raw, 34, 3) AS anticodon, substr(raw, 1, 2) || substr(raw, length(raw) - 1, 2) AS ends FROM sequences WHERE length(raw) > 40")
def str7(s):
    return s.where(F.length("raw") > 40).select("id", F.substring("raw", 34, 3).alias("anticodon"), F.concat(F.substring("raw", 1, 2), F.substring("raw", -2, 2)).alias("ends"))


@query("str8_mature_trna", "sequences", "SELECT id, replace(regexp_replace(raw, '[actgn]', '', 'g') || 'CCAA', 'U', 'T') AS seq FROM sequences")
def str8(s):
    return s.select("id", F.translate(sequence.mature_trna(F.col("raw")), "U", "T").alias("seq"))


@query("str9_names", "peaks", "SELECT chrom || ':' || CAST(start AS VARCHAR) || '-' || CAST(\"end\" AS VARCHAR) AS place, peakname || ' (' || CAST(score AS VARCHAR) || ')' AS label FROM peaks")
def str9(p):
    return p.select(F.format_string("%s:%d-%d", "chrom", "start", "end").alias("place"), F.format_string("%s (%d)", "peakname", "score").alias("label"))


@query("mth1_overlap_share", "peaks", "SELECT peakname, round(50.0 / (\"end\" - start), 6) AS share FROM peaks")
def mth1(p):
    return p.select("peakname", F.round(50.0 / (F.col("end") - F.col("start")), 6).alias("share"))


@query("mth2_logs", "expression", "SELECT k, round(ln(value + 1), 6) AS l, round(log2(value + 1), 6) AS l2, round(log10(value + 1), 6) AS l10, round(sqrt(value), 6) AS r, round(pow(10, -value / 10000), 6) AS p FROM expression")
def mth2(e):
    v = F.col("value")
    return e.select("k", F.round(F.log1p(v), 6).alias("l"), F.round(F.log2(v + 1), 6).alias("l2"), F.round(F.log10(v + 1), 6).alias("l10"), F.round(F.sqrt(v), 6).alias("r"), F.round(F.pow(F.lit(10.0), -v / 10000), 6).alias("p"))


@query("arr1_zip_names", "annotations", "SELECT DISTINCT bio_type, gene_name || '/' || strand AS pair FROM annotations")
def arr1(a):
    zipped = F.array_sort(F.array_distinct(F.zip_with(F.array("gene_name"), F.array("strand"), lambda x, y: F.concat_ws("/", x, y))))
    return a.select("bio_type", F.explode(zipped).alias("pair")).distinct()


# ------------------------------------------------------------------ equi-joins


@query("jn13_inner", "abundance counts", "SELECT target_id, a.gene_id, n FROM abundance a JOIN (SELECT gene_id, CAST(sum(read_count) AS BIGINT) AS n FROM counts GROUP BY gene_id) c USING (gene_id)")
def jn13(a, c):
    return a.join(c.groupBy("gene_id").agg(F.sum("read_count").alias("n")), "gene_id").select("target_id", "gene_id", "n")


@query("jn14_left_fill", "annotations counts", "SELECT gene_id, coalesce(n, 0) AS n FROM annotations LEFT JOIN (SELECT gene_id, CAST(sum(read_count) AS BIGINT) AS n FROM counts WHERE samplename = 'Qcf1' GROUP BY gene_id) USING (gene_id)")
def jn14(a, c):
    n = c.where("samplename = 'Qcf1'").groupBy("gene_id").agg(F.sum("read_count").alias("n"))
    return a.select("gene_id").join(n, "gene_id", "left").na.fill(0, "n")


_SIDE = "SELECT gene_id, CAST(sum(read_count) AS BIGINT) AS {0} FROM counts WHERE strand = '{0}' AND samplename = 'Qcf2' GROUP BY gene_id"


@query("jn16_full_outer", "counts", f"SELECT gene_id, sense, antisense FROM ({_SIDE.format('sense')}) FULL JOIN ({_SIDE.format('antisense')}) USING (gene_id)")
def jn16(c):
    side = lambda s: c.where((F.col("strand") == s) & (F.col("samplename") == "Qcf2")).groupBy("gene_id").agg(F.sum("read_count").alias(s))
    return side("sense").join(side("antisense"), "gene_id", "full_outer")


@query("cnt13_fold_strands", "sequences", """, t AS (SELECT substr(raw, 1, 3) AS motif, CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(count(*) AS BIGINT) AS n FROM sequences WHERE regexp_matches(raw, '^[ACGT]{3}') GROUP BY ALL)
 SELECT a.motif, a.strand, a.n + coalesce(b.n, 0) AS n FROM t a LEFT JOIN t b ON b.motif = reverse(translate(a.motif, 'ACGT', 'TGCA')) AND b.strand <> a.strand""")
def cnt13(s):
    t = s.where(F.col("raw").rlike("^[ACGT]{3}")).groupBy(F.substring("raw", 1, 3).alias("motif"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand")).agg(F.count("*").alias("n"))
    return counting.fold_strands(t, "motif", "strand", "n", sequence.reverse_complement(F.col("motif")))


@query("jn18_lookup", "fragments", "SELECT name, CASE partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '0' END AS label FROM fragments")
def jn18(f):
    table = f.sparkSession.createDataFrame([(0, "A"), (1, "B")], "k long, label string")
    return f.withColumn("k", F.col("partkey") % 4).join(F.broadcast(table), "k", "left").select("name", F.coalesce("label", F.lit("0")).alias("label"))


@query("jn19_rule_join", "counts", "SELECT treatment, CAST(count(DISTINCT samplename) AS BIGINT) AS samples, CAST(sum(read_count) AS BIGINT) AS reads FROM counts JOIN (VALUES " + ", ".join(f"('{p}', '{n}')" for p, n in rules.TREATMENTS) + ") r(pattern, treatment) ON regexp_matches(samplename, pattern) GROUP BY treatment")
def jn19(c):
    per = c.groupBy("samplename").agg(F.sum("read_count").alias("n"))
    return rules.rule_join(per, "samplename", rules.TREATMENTS, "treatment").groupBy("treatment").agg(F.count("*").alias("samples"), F.sum("n").alias("reads"))


@query("jn20_mates", "fragments", "SELECT a.name AS name1, b.name AS name2 FROM fragments a JOIN fragments b ON split_part(a.name, '_', 2) = split_part(b.name, '_', 2) AND a.mate = 1 AND b.mate = 2 AND a.strand = b.strand")
def jn20(f):
    read = F.split_part("name", F.lit("_"), F.lit(2)).alias("read")
    one, two = f.where("mate = 1").select(read, "strand", F.col("name").alias("name1")), f.where("mate = 2").select(read, "strand", F.col("name").alias("name2"))
    return one.join(two, ["read", "strand"]).select("name1", "name2")


# ------------------------------------------------------------------ count tables


@query("cnt3_wide_counts", "counts", "SELECT gene_type, gene_id, " + ", ".join(f"CAST(coalesce(sum(read_count) FILTER (samplename = '{s}' AND dedup = 'dedup' AND strand = 'sense'), 0) AS BIGINT) AS {s}" for s in SAMPLES) + " FROM counts WHERE read_count > 0 AND dedup = 'dedup' AND strand = 'sense' GROUP BY gene_type, gene_id")
def cnt3(c):
    return counting.pivot(c.where("read_count > 0 AND dedup = 'dedup' AND strand = 'sense'"), ["gene_type", "gene_id"], "samplename", SAMPLES, F.sum("read_count"))


@query("cnt9_insert_sizes", "fragments", f", {_SIZES}, p AS (SELECT sample, size, 100.0 * n / sum(n) OVER (PARTITION BY sample) AS percent FROM t WHERE size < 300) SELECT size, round(median(percent), 6) AS percent FROM p GROUP BY size")
def cnt9(f):
    t = f.groupBy("sample", (F.col("end") - F.col("start")).alias("size")).agg(F.count("*").alias("n")).where("size < 300")
    return t.withColumn("percent", counting.share("n", ["sample"], 100.0)).groupBy("size").agg(F.round(F.median("percent"), 6).alias("percent"))


@query("cnt10_composition", "counts", f", s AS (SELECT samplename, {_case('gene_type', rules.RNA_TYPE_RULES, 'other')} AS rna, sum(read_count) AS n FROM counts WHERE strand = 'sense' GROUP BY ALL), m AS (SELECT rna, median(n) AS n FROM s GROUP BY rna) SELECT rna, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM m")
def cnt10(c):
    s = c.where("strand = 'sense'").groupBy("samplename", rules.classify(F.col("gene_type"), rules.RNA_TYPE_RULES).alias("rna")).agg(F.sum("read_count").alias("n"))
    m = s.groupBy("rna").agg(F.median("n").alias("n"))
    return m.select("rna", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("percent"))


@query("cnt11_gene_expression", "abundance", ", g AS (SELECT prep, gene_id, sum(tpm) AS tpm FROM abundance GROUP BY ALL) SELECT prep, gene_id, round(tpm * 1e6 / sum(tpm) OVER (PARTITION BY prep), 4) AS tpm FROM g")
def cnt11(a):
    g = a.groupBy("prep", "gene_id").agg(F.sum("tpm").alias("tpm"))
    return g.select("prep", "gene_id", F.round(counting.share("tpm", ["prep"], 1e6), 4).alias("tpm"))


@query("cnt12_tpm", "abundance", "SELECT target_id, round((tpm / eff_length) * 1e6 / sum(tpm / eff_length) OVER (PARTITION BY prep), 4) AS value FROM abundance")
def cnt12(a):
    return a.select("target_id", F.round(counting.tpm("tpm", "eff_length", ["prep"]), 4).alias("value"))


@query("cnt14_saturation", "counts", ", g AS (SELECT gene_id, CAST(sum(read_count) AS BIGINT) AS n FROM counts GROUP BY gene_id), f AS (SELECT i / 1000.0::DOUBLE AS fraction FROM range(1, 1001) t(i)) SELECT CAST(fraction AS DOUBLE) AS fraction, CAST(cutoff AS INT) AS cutoff, CAST(count(*) FILTER (CAST(fraction AS DOUBLE) * n > cutoff) AS BIGINT) AS genes FROM g, f, (VALUES (1), (5), (10)) c(cutoff) GROUP BY ALL")
def cnt14(c):
    return counting.saturation(c.groupBy("gene_id").agg(F.sum("read_count").alias("n")), "n")


@query("cnt19_design", "counts", ", t AS (SELECT DISTINCT samplename FROM counts) SELECT samplename, CASE WHEN regexp_matches(samplename, '^Qcf[1-6]$') THEN 'control' ELSE 'RNA' END AS phenotype FROM t WHERE NOT regexp_matches(samplename, '12$')")
def cnt19(c):
    return c.select("samplename").distinct().where(~F.col("samplename").rlike("12$")).select("samplename", F.when(F.col("samplename").rlike("^Qcf[1-6]$"), "control").otherwise("RNA").alias("phenotype")).orderBy("phenotype", "samplename")


@query("cnt22_share_ranges", "counts", ", s AS (SELECT samplename, gene_type, 100.0 * sum(read_count) / sum(sum(read_count)) OVER (PARTITION BY samplename) AS p FROM counts GROUP BY samplename, gene_type) SELECT gene_type, round(min(p), 6) AS low, round(max(p), 6) AS high FROM s GROUP BY gene_type")
def cnt22(c):
    t = c.groupBy("samplename", "gene_type").agg(F.sum("read_count").alias("n")).withColumn("p", counting.share("n", ["samplename"], 100.0))
    return t.groupBy("gene_type").agg(F.round(F.min("p"), 6).alias("low"), F.round(F.max("p"), 6).alias("high"))


# ------------------------------------------------------------------ statistics


@query("st1_bh", "peaks", ", d AS (SELECT peakname, pow(10, -log10p / 100) AS p FROM peaks), r AS (SELECT *, p * count(*) OVER () / rank_max AS q FROM (SELECT *, count(*) OVER (ORDER BY p) AS rank_max FROM d)) SELECT peakname, round(least(1.0, min(q) OVER (ORDER BY p DESC)), 6) AS padj FROM r")
def st1(p):
    d = p.select("peakname", F.lit(1).alias("all"), F.pow(F.lit(10.0), -F.col("log10p") / 100).alias("p"))
    return statistics.adjust_bh(d, "p", ["all"]).select("peakname", F.round("padj", 6).alias("padj"))


@query("st3_size_factors", "counts", ", t AS (SELECT samplename, gene_id, sum(read_count) AS n FROM counts GROUP BY ALL), g AS (SELECT gene_id, avg(ln(n)) AS l FROM t GROUP BY gene_id HAVING count(*) = (SELECT count(DISTINCT samplename) FROM counts)) SELECT samplename, round(median(n / exp(l)), 6) AS size_factor FROM t JOIN g USING (gene_id) GROUP BY samplename")
def st3(c):
    t = c.groupBy("samplename", "gene_id").agg(F.sum("read_count").alias("n"))
    return counting.size_factors(t, "gene_id", "samplename", "n").select("samplename", F.round("size_factor", 6).alias("size_factor"))


_PAIR = "t AS (SELECT gene_type, gene_id, CAST(coalesce(sum(read_count) FILTER (samplename = 'Qcf1'), 0) AS DOUBLE) AS x, CAST(coalesce(sum(read_count) FILTER (samplename = 'Qcf2'), 0) AS DOUBLE) AS y FROM counts GROUP BY ALL)"


@query("st6_similarities", "counts", f""", {_PAIR}, r AS (SELECT *, rank() OVER (PARTITION BY gene_type ORDER BY x) + (count(*) OVER (PARTITION BY gene_type, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY gene_type ORDER BY y) + (count(*) OVER (PARTITION BY gene_type, y) - 1) / 2.0 AS ry, avg(x) OVER (PARTITION BY gene_type) AS mx FROM t)
 SELECT gene_type, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine, round(1 - sum((x - y) * (x - y)) / sum((x - mx) * (x - mx)), 6) AS r2 FROM r GROUP BY gene_type""")
def st6(c):
    s = lambda n: F.coalesce(F.sum(F.when(F.col("samplename") == n, F.col("read_count"))), F.lit(0)).cast("double")
    t = c.groupBy("gene_type", "gene_id").agg(s("Qcf1").alias("x"), s("Qcf2").alias("y"))
    out = statistics.similarity(t, "x", "y", ["gene_type"])
    return out.select("gene_type", *[F.round(n, 6).alias(n) for n in ("pearson", "spearman", "cosine", "r2")])


@query("st4_beta_prior", "counts", ", t AS (SELECT gene_type, gene_id, sum(read_count) FILTER (strand = 'sense') / sum(read_count) AS p FROM counts GROUP BY ALL HAVING sum(read_count) > 100), m AS (SELECT gene_type, avg(p) AS m, var_samp(p) AS v FROM t WHERE p > 0 AND p < 1 GROUP BY gene_type) SELECT gene_type, round(m * (m * (1 - m) / v - 1), 4) AS alpha0, round((1 - m) * (m * (1 - m) / v - 1), 4) AS beta0 FROM m")
def st4(c):
    t = c.groupBy("gene_type", "gene_id").agg((F.sum(F.when(F.col("strand") == "sense", F.col("read_count"))) / F.sum("read_count")).alias("p"), F.sum("read_count").alias("n"))
    fit = t.where("n > 100 AND p > 0 AND p < 1").groupBy("gene_type").agg(*statistics.beta_prior(F.col("p")))
    return fit.select("gene_type", F.round("alpha0", 4).alias("alpha0"), F.round("beta0", 4).alias("beta0"))


@query("st5_beta_posterior", "counts")
def st5(c):
    t = c.groupBy("gene_type", "gene_id").agg(F.sum(F.when(F.col("strand") == "sense", F.col("read_count")).otherwise(0)).alias("hits"), F.sum("read_count").alias("total"))
    share = F.col("hits") / F.col("total")
    prior = t.where("total > 100 AND hits > 0 AND hits < total").groupBy("gene_type").agg(*statistics.beta_prior(share))
    return statistics.beta_posterior(t.join(F.broadcast(prior), "gene_type"), "hits", "total").select("gene_id", F.round("posterior", 6).alias("posterior"), F.round("log_bf", 4).alias("log_bf"), F.round("below_half", 6).alias("below_half"))


@query("st10_rank_sum", "counts")
def st10(c):
    t = c.groupBy("gene_type", "gene_id", "strand").agg(F.sum("read_count").alias("n"))
    return statistics.rank_sum(t, "n", "strand", "sense", ["gene_type"]).select("gene_type", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("st11_dispersion", "counts", ", t AS (SELECT gene_id, samplename, sum(read_count) AS n FROM counts GROUP BY ALL) SELECT gene_id, round(avg(n), 6) AS mean, round(var_samp(n), 6) AS variance, round(stddev_samp(n) / avg(n), 6) AS cv, round((var_samp(n) - avg(n)) / (avg(n) * avg(n)), 6) AS dispersion FROM t GROUP BY gene_id HAVING count(*) > 1")
def st11(c):
    t = c.groupBy("gene_id", "samplename").agg(F.sum("read_count").alias("n")).groupBy("gene_id").agg(F.avg("n").alias("m"), F.var_samp("n").alias("v"), F.count("*").alias("k")).where("k > 1")
    r = lambda x, n: F.round(x, 6).alias(n)
    m, v = F.col("m"), F.col("v")
    return t.select("gene_id", r(m, "mean"), r(v, "variance"), r(F.sqrt(v) / m, "cv"), r((v - m) / (m * m), "dispersion"))


@query("st13_fold_changes", "counts", f", {_PAIR} SELECT gene_id, round(log2((x + 1) / (y + 1)), 6) AS log2fc, abs(log2((x + 1) / (y + 1))) >= 1 AS significant FROM t")
def st13(c):
    s = lambda n: F.coalesce(F.sum(F.when(F.col("samplename") == n, F.col("read_count"))), F.lit(0)).cast("double")
    t = c.groupBy("gene_type", "gene_id").agg(s("Qcf1").alias("x"), s("Qcf2").alias("y"))
    fc = F.log2((F.col("x") + 1) / (F.col("y") + 1))
    return t.select("gene_id", F.round(fc, 6).alias("log2fc"), (F.abs(fc) >= 1).alias("significant"))


@query("st14_difference", "fragments", ", x AS (SELECT \"end\" - start AS v, count(*) / sum(count(*)) OVER () AS p FROM fragments WHERE strand = '+' GROUP BY 1), y AS (SELECT \"end\" - start AS v, count(*) / sum(count(*)) OVER () AS p FROM fragments WHERE strand = '-' GROUP BY 1), d AS (SELECT sum(x.p * y.p) AS p FROM x, y WHERE x.v - y.v > 10) SELECT round(p, 6) AS p, round(p / (1 - p), 6) AS odds FROM d")
def st14(f):
    def pmf(s):
        t = f.where(F.col("strand") == s).groupBy((F.col("end") - F.col("start")).alias("value")).agg(F.count("*").alias("n"))
        return t.select("value", counting.share("n", []).alias("p"))

    d = statistics.difference_over(pmf("+"), pmf("-"), 10)
    return d.select(F.round("p", 6).alias("p"), F.round("odds", 6).alias("odds"))


@query("st16_composition", "annotations", "SELECT bio_type, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM annotations GROUP BY bio_type")
def st16(a):
    t = a.groupBy("bio_type").agg(F.count("*").alias("n"))
    return t.select("bio_type", "n", F.round(counting.share("n", [], 100.0), 6).alias("percent"))
