"""Queries for interval joins, coverage, duplicate removal, annotation and counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, counting, coverage, dedup, statistics
from ..operators import interval_join as ij
from .registry import query

L = lambda c: c.cast("long")
ON = 'a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end"'
OV = '(least(a."end", b."end") - greatest(a.start, b.start))'
LEN_A, LEN_B = '(a."end" - a.start)', '(b."end" - b.start)'


# ------------------------------------------------------------------ joins


@query("jn1_inner", "fragments annotations", f"SELECT a.name, b.gene_id, CAST({OV} AS BIGINT) AS overlap FROM fragments a JOIN annotations b ON {ON}")
def jn1(f, a):
    return ij.pairs(f, a).select("name", F.col("b_gene_id").alias("gene_id"), "overlap")


@query("jn2_left", "peaks annotations", f"SELECT a.peakname, b.gene_id, CAST(CASE WHEN b.gene_id IS NULL THEN 0 ELSE {OV} END AS BIGINT) AS overlap FROM peaks a LEFT JOIN annotations b ON {ON}")
def jn2(p, a):
    return ij.interval_left(p, a, width=128).select("peakname", F.col("b_gene_id").alias("gene_id"), "overlap")


@query("jn3_anti", "peaks annotations exons", f"SELECT peakname FROM peaks a WHERE NOT EXISTS (SELECT 1 FROM annotations b WHERE {ON} AND b.bio_type = 'miRNA') AND NOT EXISTS (SELECT 1 FROM exons b WHERE {ON} AND b.exon_count = 1)")
def jn3(p, a, e):
    return ij.interval_anti(p, [a.where("bio_type = 'miRNA'"), e.where("exon_count = 1")]).select("peakname")


@query("jn4_fractions", "peaks annotations", f"SELECT a.peakname, b.gene_id FROM peaks a JOIN annotations b ON {ON} AND {OV} >= 0.5 * {LEN_A} AND {OV} >= 0.1 * {LEN_B}")
def jn4(p, a):
    return ij.pairs(p, a, frac_a=0.5, frac_b=0.1, width=128).select("peakname", F.col("b_gene_id").alias("gene_id"))


@query("jn5_same_strand", "fragments annotations", f"SELECT a.name, b.gene_id FROM fragments a JOIN annotations b ON {ON} AND a.strand = b.strand")
def jn5(f, a):
    return ij.pairs(f, a, strand="same").select("name", F.col("b_gene_id").alias("gene_id"))


@query("jn5_opposite_strand", "fragments annotations", f"SELECT a.name, b.gene_id FROM fragments a JOIN annotations b ON {ON} AND a.strand <> b.strand")
def jn5b(f, a):
    return ij.pairs(f, a, strand="opposite").select("name", F.col("b_gene_id").alias("gene_id"))


@query("jn6_several_sets", "peaks exons annotations", f', b AS (SELECT chrom, start, "end", 1 AS filenum FROM exons UNION ALL SELECT chrom, start, "end", 2 FROM annotations) SELECT a.peakname, CAST(b.filenum AS INT) AS filenum, CAST({OV} AS BIGINT) AS overlap FROM peaks a JOIN b ON {ON}')
def jn6(p, e, a):
    both = ij.by_set({1: e.select("chrom", "start", "end"), 2: a.select("chrom", "start", "end")})
    return ij.pairs(p, both).select("peakname", F.col("b_filenum").alias("filenum"), "overlap")


@query("jn7_exists_label", "peaks annotations", f"SELECT a.peakname, (SELECT min(b.gene_name) FROM annotations b WHERE {ON} AND b.bio_type = 'RBP') AS rbp FROM peaks a")
def jn7(p, a):
    return ij.has_overlap(p, a.where("bio_type = 'RBP'"), "rbp", label="gene_name").select("peakname", "rbp")


@query("jn8_containment", "fragments annotations", 'SELECT a.name FROM fragments a WHERE EXISTS (SELECT 1 FROM annotations b WHERE a.chrom = b.chrom AND b.start < a.start AND b."end" > a."end")')
def jn8(f, a):
    inside = (F.col("b_start") < F.col("start")) & (F.col("b_end") > F.col("end"))
    return ij.interval_semi(f, a, where=inside).select("name")


@query("jn9_exists_flag", "peaks exons", f"SELECT a.peakname, CASE WHEN EXISTS (SELECT 1 FROM exons b WHERE {ON}) THEN 'yes' ELSE 'no' END AS exonic FROM peaks a")
def jn9(p, e):
    return ij.has_overlap(p, e, "hit").select("peakname", F.when(F.col("hit"), "yes").otherwise("no").alias("exonic"))


_PAIRS = f", m AS (SELECT split_part(name, '_', 2) AS pair, EXISTS (SELECT 1 FROM annotations b WHERE {ON}) AS hit FROM fragments a)"


@query("jn10_pairs", "fragments annotations", f"{_PAIRS} SELECT pair, bool_or(hit) AS either, bool_and(hit) AS \"both\" FROM m GROUP BY pair")
def jn10(f, a):
    mates = f.withColumn("pair", F.split_part("name", F.lit("_"), F.lit(2))).select("pair", "chrom", "start", "end", "strand")
    return ij.pair_class(mates, a, "pair")


@query("jn11_best_gene", "peaks annotations", f"SELECT a.peakname, arg_min(b.gene_name, {{'o': -({OV}), 'n': b.gene_name}}) AS best_gene_name FROM peaks a LEFT JOIN annotations b ON {ON} AND a.strand = b.strand GROUP BY a.peakname")
def jn11(p, a):
    return ij.best_overlap(p, a, "gene_name", strand="same").select("peakname", "best_gene_name")


@query("jn12_points", "peaks fragments", 'SELECT a.peakname, CAST(count(DISTINCT b.start) AS BIGINT) AS points FROM peaks a LEFT JOIN fragments b ON a.chrom = b.chrom AND b.start >= a.start AND b.start < a."end" GROUP BY a.peakname')
def jn12(p, f):
    return counting.points_inside(p, f.select("chrom", F.col("start").alias("pos")), "peakname").select("peakname", "points")


@query("jn21_projection", "exons abundance", """, x AS (SELECT name, chrom, start, "end", strand, CAST(sum("end" - start) OVER (PARTITION BY name ORDER BY exon_no ROWS UNBOUNDED PRECEDING) - ("end" - start) AS BIGINT) AS t0 FROM exons), q AS (SELECT 'G' || substr(target_id, 2) AS name, target_id, CAST(eff_length // 10 AS BIGINT) AS p FROM abundance)
 SELECT target_id, chrom, x.start + p - t0 AS pos FROM q JOIN x USING (name) WHERE p >= t0 AND p < t0 + "end" - x.start""")
def jn21(e, a):
    from pyspark.sql.window import Window

    w = Window.partitionBy("name").orderBy("exon_no").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("end") - F.col("start")
    x = e.withColumn("t0", F.sum(size).over(w) - size)
    q = a.select(F.concat(F.lit("G"), F.expr("substr(target_id, 2)")).alias("name"), "target_id", F.expr("eff_length DIV 10").alias("p"))
    return q.join(x, "name").where((F.col("p") >= F.col("t0")) & (F.col("p") < F.col("t0") + size)).select("target_id", "chrom", (F.col("start") + F.col("p") - F.col("t0")).alias("pos"))


@query("ag5_region_counts", "peaks fragments", f"SELECT a.peakname, CAST(count(b.name) AS BIGINT) AS reads, CAST(count(*) FILTER (a.strand = b.strand) AS BIGINT) AS stranded FROM peaks a LEFT JOIN fragments b ON {ON} GROUP BY a.peakname")
def ag5(p, f):
    return counting.region_counts(p, f, "peakname").select("peakname", "reads", "stranded")


@query("ag7_merge", "fragments", """, o AS (SELECT chrom, start, "end", max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fragments), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < start THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT chrom, min(start) AS start, max("end") AS "end", CAST(count(*) AS BIGINT) AS n FROM i GROUP BY chrom, k""")
def ag7(f):
    return ij.merge_intervals(f, tile=20_000)


@query("ag9_full_length", "fragments annotations", f'SELECT b.gene_id, CAST(count(*) FILTER (abs(a.start - b.start) < 5 AND abs(a."end" - b."end") < 5) AS BIGINT) AS full_length FROM fragments a JOIN annotations b ON {ON} AND a.strand = b.strand GROUP BY b.gene_id')
def ag9(f, a):
    return counting.full_length(f, a, "gene_id").select("gene_id", "full_length")


@query("ag10_flush_ends", "peaks fragments", f", n AS (SELECT a.peakname, b.start, count(*) AS n FROM peaks a JOIN fragments b ON {ON} AND a.strand = b.strand GROUP BY ALL) SELECT peakname, round(max(n) / sum(n), 6) AS flush FROM n GROUP BY peakname")
def ag10(p, f):
    return counting.flush_ends(p, f, "peakname").select("peakname", F.round("flush", 6).alias("flush"))


@query("ag24_nested_counts", "fragments annotations", f"SELECT b.strand AS feature_strand, a.strand AS strand, CAST(least({LEN_A}, 75) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n FROM fragments a JOIN annotations b ON {ON} AND b.bio_type = 'Simple_repeat' GROUP BY ALL")
def ag24(f, a):
    j = ij.interval_join(f, a.where("bio_type = 'Simple_repeat'"))
    return j.groupBy(F.col("b_strand").alias("feature_strand"), "strand", F.least(F.col("end") - F.col("start"), F.lit(75)).cast("long").alias("size")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ coverage

_RUNS = """e AS (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, start AS pos, 1 AS d FROM fragments UNION ALL SELECT chrom, "end", -1 FROM fragments) GROUP BY ALL),
 s AS (SELECT chrom, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM e WINDOW w AS (PARTITION BY chrom ORDER BY pos)), g AS (SELECT *, CASE WHEN lag(depth) OVER w = depth THEN 0 ELSE 1 END AS n FROM s WHERE "end" IS NOT NULL WINDOW w AS (PARTITION BY chrom ORDER BY start)),
 r AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY start) AS k FROM g), runs AS (SELECT chrom, min(start) AS start, max("end") AS "end", CAST(any_value(depth) AS BIGINT) AS depth FROM r GROUP BY chrom, k)"""


@query("cov1_coverage", "fragments", f", {_RUNS} SELECT chrom, start, \"end\", depth FROM runs WHERE depth > 0")
def cov1(f):
    return coverage.coverage_runs(f, tile=10_000).select("chrom", "start", "end", "depth")


_STEPS = f"""h AS (SELECT a.peakname, greatest(a.start, b.start) AS lo, least(a."end", b."end") AS hi FROM peaks a JOIN fragments b ON {ON}),
 e AS (SELECT peakname, pos, sum(d) AS d FROM (SELECT peakname, lo AS pos, 1 AS d FROM h UNION ALL SELECT peakname, hi, -1 FROM h) GROUP BY ALL), st AS (SELECT peakname, pos, lead(pos) OVER w AS nxt, CAST(sum(d) OVER w AS BIGINT) AS depth FROM e WINDOW w AS (PARTITION BY peakname ORDER BY pos))"""


@query("cov2_pileup", "peaks fragments", f", {_STEPS}, m AS (SELECT peakname, max(depth) AS pileup FROM st GROUP BY peakname) SELECT peakname, coalesce(pileup, 0) AS pileup FROM peaks LEFT JOIN m USING (peakname)")
def cov2(p, f):
    return coverage.pileup(p, f, ["peakname"], wide=False)


@query("ag4_samples", "peaks fragments", f", {_STEPS}, m AS (SELECT peakname, max(depth) AS pileup FROM st GROUP BY peakname), n AS (SELECT a.peakname, count(DISTINCT b.sample) AS k FROM peaks a JOIN fragments b ON {ON} GROUP BY a.peakname) SELECT peakname, CAST(least(k, pileup) AS BIGINT) AS sample_count FROM m JOIN n USING (peakname)")
def ag4(p, f):
    n = coverage.distinct_covering(p, f, ["peakname"], "sample").withColumnRenamed("sample_count", "k")
    return coverage.pileup(p, f, ["peakname"], wide=False).join(n, "peakname").select("peakname", F.least("k", "pileup").alias("sample_count"))


@query("ag12_breadth", "peaks fragments", f", {_STEPS}, m AS (SELECT peakname, sum((nxt - pos) * depth) AS b, sum(CASE WHEN depth >= 2 THEN nxt - pos ELSE 0 END) AS d FROM st WHERE nxt IS NOT NULL GROUP BY peakname) SELECT peakname, round(coalesce(b, 0) / (\"end\" - start), 6) AS mean_depth, round(coalesce(d, 0) / (\"end\" - start), 6) AS breadth FROM peaks LEFT JOIN m USING (peakname)")
def ag12(p, f):
    return coverage.breadth(p, f, ["peakname"], 2, wide=False).select("peakname", F.round("mean_depth", 6).alias("mean_depth"), F.round("breadth", 6).alias("breadth"))


@query("ag13_depth_histogram", "peaks fragments", f", {_STEPS} SELECT peakname, depth, CAST(sum(nxt - pos) AS BIGINT) AS bases FROM st WHERE nxt IS NOT NULL AND depth > 0 GROUP BY peakname, depth")
def ag13(p, f):
    return coverage.depth_histogram(p, f, ["peakname"], wide=False)


@query("ag14_summit", "peaks fragments", f", {_STEPS} SELECT peakname, arg_min(pos, {{'d': -depth, 'p': pos}}) AS summit, max(depth) AS depth FROM st WHERE nxt IS NOT NULL GROUP BY peakname")
def ag14(p, f):
    return coverage.summits(p, f, ["peakname"], wide=False)


@query("ag11_mean_signal", "peaks fragments", f", {_RUNS}, m AS (SELECT a.peakname, sum(b.depth * ({OV})) AS s FROM peaks a JOIN runs b ON {ON} GROUP BY a.peakname) SELECT peakname, round(coalesce(s, 0) / (\"end\" - start), 6) AS mean_signal FROM peaks LEFT JOIN m USING (peakname)")
def ag11(p, f):
    track = coverage.coverage_runs(f, tile=10_000, merged=False).withColumnRenamed("depth", "value")
    return coverage.mean_signal(p, track, ["peakname"]).select("peakname", F.round("mean_signal", 6).alias("mean_signal"))


_SCORES = """e AS (SELECT chrom, strand, pos, sum(d) AS d FROM (SELECT chrom, strand, unnest([start - 5, start, "end", "end" + 5]) AS pos, unnest([-1, 2, -2, 1]) AS d FROM fragments) GROUP BY ALL),
 r AS (SELECT chrom, strand, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS score FROM e WINDOW w AS (PARTITION BY chrom, strand ORDER BY pos))"""


@query("cov3_protection", "peaks fragments", f"""
, {_SCORES}, h AS (SELECT a.peakname, b.score, sum(least(a."end" + 10, b."end") - greatest(a.start, b.start)) AS n FROM peaks a JOIN r b ON a.chrom = b.chrom AND a.strand = b.strand AND a.start < b."end" AND b.start < a."end" + 10 AND b.score <> 0 GROUP BY ALL),
 t AS (SELECT peakname, max(score) AS top, sum(n) AS covered FROM h GROUP BY peakname), u AS (SELECT peakname, CASE WHEN covered < "end" + 10 - start THEN greatest(top, 0) ELSE top END AS top FROM t JOIN peaks USING (peakname)), v AS (SELECT peakname, sum(n) AS n FROM h JOIN u USING (peakname) WHERE score > 0.8::DOUBLE * top GROUP BY peakname)
 SELECT peakname, round(coalesce(n, 0) / ("end" - start), 6) AS protected FROM peaks LEFT JOIN v USING (peakname)""")
def cov3(p, f):
    return coverage.protection(p, f, ["peakname"], strand="same").select("peakname", F.round("protected", 6).alias("protected"))


_EXON_STEPS = _STEPS.replace("peakname", "ekey").replace("FROM peaks a", "FROM (SELECT *, name || '/' || CAST(exon_no AS VARCHAR) AS ekey FROM exons) a")


@query("cov4_uniform_exons", "exons fragments", f", {_EXON_STEPS}, m AS (SELECT ekey, sum((nxt - pos) * depth) AS b, sum(CASE WHEN depth >= 3 THEN nxt - pos ELSE 0 END) AS d FROM st WHERE nxt IS NOT NULL GROUP BY ekey) SELECT name, CAST(exon_no AS INT) AS exon_no FROM exons LEFT JOIN m ON ekey = name || '/' || CAST(exon_no AS VARCHAR) WHERE exon_count < 2 OR (coalesce(d, 0) / (\"end\" - start) > 0.8 AND coalesce(b, 0) / (\"end\" - start) > 2)")
def cov4(e, f):
    b = coverage.breadth(e, f, ["name", "exon_no", "exon_count"], 3)
    return b.where("exon_count < 2 OR (breadth > 0.8 AND mean_depth > 2)").select("name", F.col("exon_no").cast("int").alias("exon_no"))


def segments_sql(runs: str, p: str = "") -> str:
    """CTEs that end in <p>called: the segments of a table of runs over a depth of 1."""
    return f"""{p}h AS (SELECT *, CASE WHEN start - lag("end") OVER w <= 10 THEN 0 ELSE 1 END AS n FROM {runs} WHERE depth > 1 WINDOW w AS (PARTITION BY chrom ORDER BY start)), {p}i AS (SELECT chrom, start, "end", depth, sum(n) OVER (PARTITION BY chrom ORDER BY start) AS k FROM {p}h),
 {p}l AS (SELECT chrom, k, max("end") - min(start) AS len, sum("end" - start) AS bases FROM {p}i GROUP BY ALL HAVING len BETWEEN 40 AND 450), {p}b AS (SELECT chrom, k, CAST(depth AS DOUBLE) AS depth, unnest(range("end" - start)) AS base FROM {p}i JOIN {p}l USING (chrom, k) UNION ALL SELECT chrom, k, 0.0::DOUBLE, unnest(range(CAST(len - bases AS BIGINT))) FROM {p}l),
 {p}m AS (SELECT chrom, k, quantile_cont(depth, 0.5) AS med FROM {p}b GROUP BY ALL), {p}a AS (SELECT i.*, len, med, CASE WHEN lag("end") OVER (PARTITION BY chrom, k ORDER BY start) = start THEN 0 ELSE 1 END AS cut FROM {p}i i JOIN {p}l USING (chrom, k) JOIN {p}m USING (chrom, k) WHERE depth >= med), {p}p AS (SELECT *, sum(cut) OVER (PARTITION BY chrom, k ORDER BY start) AS piece FROM {p}a),
 {p}q AS (SELECT chrom, k, piece, any_value(len) AS len, min(start) AS start, max("end") AS "end", CAST(max(depth) AS BIGINT) AS top, sum((depth - med) * ("end" - start)) AS gain FROM {p}p GROUP BY ALL), {p}o AS (SELECT *, row_number() OVER (PARTITION BY chrom, k ORDER BY gain DESC, start) AS place FROM {p}q),
 {p}called AS (SELECT chrom, start, "end", top, (start + "end") / 2.0::DOUBLE AS center FROM {p}o WHERE (len <= 150 AND place = 1 AND "end" - start > 5) OR (len > 150 AND "end" - start > 50 AND "end" - start < 150))"""


@query("cov6_segments", "fragments", f", {_RUNS}, {segments_sql('runs')} SELECT * FROM called")
def cov6(f):
    return coverage.segments(coverage.coverage_runs(f, tile=10_000), 1)


# ------------------------------------------------------------------ duplicates


@query("umi1_exact", "dedup", 'SELECT chrom, start, "end", strand, umi, min(name) AS name, CAST(count(*) AS BIGINT) AS copies FROM dedup GROUP BY chrom, start, "end", strand, umi')
def umi1(d):
    return dedup.dedup_exact(d).select("chrom", "start", "end", "strand", "umi", "name", "copies")


@query("umi2_clustered", "fragments")
def umi2(f):
    return dedup.dedup_clustered(f.withColumns({"start": F.floor(F.col("start") / 5000) * 5000, "end": F.floor(F.col("start") / 5000) * 5000 + 50}))


@query("umi3_coordinates", "dedup", 'SELECT chrom, start, "end", strand, min(name) AS name FROM dedup GROUP BY chrom, start, "end", strand')
def umi3(d):
    return d.groupBy("chrom", "start", "end", "strand").agg(F.min("name").alias("name"))


@query("umi4_poisson", "dedup", 'SELECT chrom, start, strand, round(-16.0 * ln(1 - least(count(DISTINCT umi), 15) / 16.0), 6) AS molecules FROM dedup GROUP BY chrom, start, strand')
def umi4(d):
    n = d.groupBy("chrom", "start", "strand").agg(F.countDistinct("umi").alias("n"))
    return n.select("chrom", "start", "strand", F.round(dedup.poisson_umi(F.col("n"), 2), 6).alias("molecules"))


@query("umi5_mark", "dedup", 'SELECT name, row_number() OVER (PARTITION BY chrom, start, "end", strand ORDER BY quality DESC, name) > 1 AS is_duplicate FROM dedup')
def umi5(d):
    return dedup.mark_duplicates(d, "start", "end", "strand", "quality", "name").select("name", "is_duplicate")


# ------------------------------------------------------------------ annotation

_RANK = "CASE bio_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(annotate.TYPE_RANK, 1)) + f" ELSE {len(annotate.TYPE_RANK) + 1} END"
_SCORED = f"""s AS (SELECT a.peakname, b.gene_name, b.bio_type, CAST({OV} AS BIGINT) AS overlap, ({OV}) / {LEN_B} AS ref_overlap, ({OV}) / {LEN_A} AS peak_overlap, (({OV}) / {LEN_B}) * (({OV}) / {LEN_A}) AS score_overlap,
 CASE WHEN b.gene_name IS NULL THEN {len(annotate.TYPE_RANK) + 1} ELSE {_RANK} END AS rank, coalesce(a.strand = b.strand OR b.bio_type = 'Simple_repeat', FALSE) AS is_sense FROM peaks a LEFT JOIN annotations b ON {ON})"""


@query("ann1_scores", "peaks annotations", f", {_SCORED} SELECT peakname, gene_name, round(coalesce(ref_overlap, 0.0), 9) AS ref_overlap, round(coalesce(score_overlap, 0.0), 9) AS score_overlap, CAST(rank AS INT) AS rank, is_sense FROM s")
def ann1(p, a):
    s = annotate.score_overlaps(p, a)
    return s.select("peakname", F.col("b_gene_name").alias("gene_name"), F.round("ref_overlap", 9).alias("ref_overlap"), F.round("score_overlap", 9).alias("score_overlap"), "rank", "is_sense")


_SMALL = "(CASE WHEN bio_type IN (" + ", ".join(f"'{t}'" for t in annotate.SMALL_RNA) + ") THEN 1 ELSE 0 END)"
_RESOLVED = f"""{_SCORED}, o AS (SELECT *, {_SMALL} AS small, row_number() OVER (PARTITION BY peakname, is_sense ORDER BY {_SMALL} DESC, coalesce(score_overlap, 0) DESC, rank, gene_name) AS k FROM s),
 w AS (SELECT peakname, is_sense, small AS ws, rank AS wr, coalesce(score_overlap, 0) AS wo FROM o WHERE k = 1), res AS (SELECT o.peakname, o.is_sense, coalesce(string_agg(DISTINCT gene_name, ',' ORDER BY gene_name), '') AS gname, min(bio_type) AS gtype FROM o JOIN w USING (peakname, is_sense) WHERE k = 1 OR (bio_type = 'RBP' AND ws = 0 AND rank = wr AND score_overlap = wo) GROUP BY ALL)"""


@query("ann2_resolve", "peaks annotations", f", {_RESOLVED} SELECT peakname, is_sense, gname, gtype FROM res")
def ann2(p, a):
    return annotate.resolve(annotate.best_scored(p, a)).select("peakname", "is_sense", "gname", "gtype")


_WIDE = f"{_RESOLVED}, t AS (SELECT peakname, " + ", ".join(f"coalesce(max(CASE WHEN is_sense = {v} AND {c} <> '' THEN {c} END), '.') AS {p}_{c}" for p, v in (("sense", "TRUE"), ("antisense", "FALSE")) for c in ("gname", "gtype")) + " FROM res GROUP BY peakname)"


@query("ann3_sense_antisense", "peaks annotations", f", {_WIDE} SELECT * FROM t")
def ann3(p, a):
    return annotate.sense_antisense(p, annotate.resolve(annotate.best_scored(p, a))).drop("chrom", "start", "end", "strand")


@query("ann4_sense_labels", "peaks annotations", f", {_WIDE} SELECT CASE WHEN sense_gname <> '.' THEN 'Sense' WHEN antisense_gname <> '.' THEN 'Antisense' ELSE 'Unannotated' END AS label, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def ann4(p, a):
    t = annotate.sense_antisense(p, annotate.resolve(annotate.best_scored(p, a)))
    return t.groupBy(annotate.sense_label(F.col("sense_gname"), F.col("antisense_gname")).alias("label")).agg(F.count("*").alias("n"))


@query("ann6_full_length_intron", "fragments exons", f"SELECT DISTINCT a.name FROM fragments a JOIN exons b ON {ON} AND a.strand = b.strand AND {OV} >= 0.9 * {LEN_A} AND {OV} >= 0.5 * {LEN_B}")
def ann6(f, e):
    return ij.interval_semi(f, e, strand="same", frac_a=0.9, frac_b=0.5).select("name").distinct()


@query("cat1_catalogue", "annotations", "SELECT chrom, start, \"end\", gene_id, CASE WHEN bio_type = 'RBP' THEN split_part(gene_name, '-', 1) ELSE gene_name END AS name, bio_type FROM annotations WHERE (bio_type = 'RBP' AND size > 2) OR regexp_matches(bio_type, 'miRNA|tRNA')")
def cat1(a):
    rbp = a.where("bio_type = 'RBP' AND size > 2").withColumn("name", F.split_part("gene_name", F.lit("-"), F.lit(1)))
    small = a.where(F.col("bio_type").rlike("miRNA|tRNA")).withColumn("name", F.col("gene_name"))
    cols = ("chrom", "start", "end", "gene_id", "name", "bio_type")
    return rbp.select(*cols).unionByName(small.select(*cols)).orderBy("chrom", "start", "gene_id")


# ------------------------------------------------------------------ counting


@query("cnt1_best_assignment", "fragments annotations", f"SELECT a.name, arg_min(b.gene_id, {{'s': -round({OV} / {LEN_A} * ({OV}) / {LEN_B}, 9), 'g': b.gene_id}}) AS gene_id FROM fragments a JOIN annotations b ON {ON} GROUP BY a.name")
def cnt1(f, a):
    return counting.best_assignment(f, a, by="name").select("name", "gene_id")


@query("cnt2_gene_counts", "fragments annotations", f""", j AS (SELECT a.sample, a.strand, b.strand AS ref, coalesce(b.gene_id, '.') AS gene_id, coalesce(b.gene_name, '.') AS gene_name, coalesce(b.bio_type, 'No features') AS bio_type FROM fragments a LEFT JOIN annotations b ON {ON})
 SELECT sample, orientation, gene_id, gene_name, bio_type, CAST(count(*) AS BIGINT) AS read_count FROM (SELECT *, 'sense' AS orientation FROM j WHERE ref IS NULL OR strand = ref UNION ALL SELECT *, 'antisense' FROM j WHERE ref IS NULL OR strand <> ref) GROUP BY sample, orientation, gene_id, gene_name, bio_type""")
def cnt2(f, a):
    return counting.gene_counts(f, a)


@query("cnt4_trna_fragments", "fragments annotations", f""", j AS (SELECT b.gene_id, a.umi, a.start - b.start AS s, a."end" - b.start AS e, {LEN_B} AS size, {LEN_A} AS len FROM fragments a JOIN annotations b ON {ON} AND a.strand = b.strand AND b.bio_type = 'tRNA'),
 c AS (SELECT gene_id, umi, CASE WHEN s < 5 AND e >= size - 5 THEN 'Full-length tRNA' WHEN s < 5 AND e BETWEEN size // 2 - 1 AND size // 2 + 4 THEN '5'' half' WHEN e >= size - 5 AND s BETWEEN size // 2 - 3 AND size // 2 + 2 THEN '3'' half' WHEN s < 5 AND len < 23 THEN 'tRF-5' WHEN e >= size - 5 AND len < 23 THEN 'tRF-3' ELSE 'Others' END AS class FROM j)
 SELECT gene_id, class, round(-4096.0 * ln(1 - least(count(DISTINCT umi), 4095) / 4096.0), 6) AS molecules FROM c GROUP BY ALL""")
def cnt4(f, a):
    n = counting.trna_barcodes(f, a.where("bio_type = 'tRNA'"), "gene_id", "umi")
    return n.select("gene_id", "class", F.round(dedup.poisson_umi(F.col("n"), 6), 6).alias("molecules"))


@query("cnt5_mirna_counts", "fragments annotations", f", n AS (SELECT a.sample, b.gene_id, count(*) AS n FROM fragments a JOIN annotations b ON {ON} AND a.strand = b.strand AND b.bio_type = 'miRNA' AND {LEN_A} < 100 GROUP BY ALL) SELECT sample, gene_id, CAST(n AS BIGINT) AS n, round(n * 1e6 / sum(n) OVER (PARTITION BY sample), 4) AS cpm FROM n")
def cnt5(f, a):
    n = ij.interval_join(f.where(F.col("end") - F.col("start") < 100), a.where("bio_type = 'miRNA'"), strand="same").groupBy("sample", F.col("b_gene_id").alias("gene_id")).agg(F.count("*").alias("n"))
    return n.select("sample", "gene_id", "n", F.round(counting.share("n", ["sample"], 1e6), 4).alias("cpm"))


@query("cnt6_orientation", "fragments annotations", f"SELECT b.gene_id, CAST(count(*) FILTER (a.strand = b.strand) AS BIGINT) AS sense, CAST(count(*) FILTER (a.strand <> b.strand) AS BIGINT) AS antisense FROM fragments a JOIN annotations b ON {ON} AND {LEN_A} < 1.1::DOUBLE * {LEN_B} AND b.bio_type = 'lncRNA' GROUP BY b.gene_id")
def cnt6(f, a):
    return counting.orientations(f, a.where("bio_type = 'lncRNA'"), "gene_id", 1.1)


@query("cnt7_terminal_classes", "fragments annotations", f"""SELECT CASE WHEN a.start - b.start < 5 AND b."end" - a."end" < 5 THEN 'full' WHEN a.start - b.start < 5 THEN '5 end' WHEN b."end" - a."end" < 5 THEN '3 end' ELSE 'internal' END AS class, {LEN_A} < 45 AS short, CAST(count(*) AS BIGINT) AS n FROM fragments a JOIN annotations b ON {ON} AND a.start >= b.start AND a."end" <= b."end" GROUP BY ALL""")
def cnt7(f, a):
    return counting.terminal_classes(f, a)


@query("cnt17_junctions_in_peaks", "exons peaks", """, j AS (SELECT name, chrom, "end" AS pos FROM exons), h AS (SELECT j.name, j.pos, p.peakname FROM j JOIN peaks p ON j.chrom = p.chrom AND j.pos >= p.start AND j.pos <= p."end") SELECT name, CAST(count(DISTINCT pos) AS BIGINT) AS junctions, CAST(count(DISTINCT peakname) AS BIGINT) AS peaks FROM h GROUP BY name""")
def cnt17(e, p):
    found = counting.labels_at_points(e.select("name", "chrom", F.col("end").alias("pos")), p.withColumn("end", F.col("end") + 1), "name", "peakname")
    return found.select("name", F.col("points").alias("junctions"), F.col("labels").alias("peaks"))


_ST2 = ', o AS (SELECT DISTINCT chrom, fc FROM peaks), d AS (SELECT chrom, ("end" - start) / 4.0 AS draw, count(*) AS n FROM fragments GROUP BY ALL), v AS (SELECT chrom, fc, round(sum(CASE WHEN draw >= fc THEN n ELSE 0 END) / sum(n), 9) AS p FROM o JOIN d USING (chrom) GROUP BY chrom, fc) SELECT peakname, p FROM peaks JOIN v USING (chrom, fc)'


@query("st2_empirical_p", "peaks fragments", _ST2)
def st2(p, f):
    null = f.select("chrom", ((F.col("end") - F.col("start")) / 4.0).alias("draw"))
    return p.join(statistics.empirical_p(p, null, "chrom", "fc", less=False), ["chrom", "fc"]).select("peakname", F.round("p", 9).alias("p"))
