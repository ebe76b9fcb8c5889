"""Small compositions: column selection, sampling, two-pass calling, components, user scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .coverage import segments
from .interval_join import interval_anti
from .staging import written

#: Motifs of telomeres and centromeres, which count on both strands.
_TELOMERES = ("TAACCC", "CCCGAA", "CCCCAA", "CCCTAG", "TTAGGC", "TTAGGG")
_CENTROMERES = ("GAATG",)


def _both_strands(motifs: tuple[str, ...]) -> str:
    return "|".join(dict.fromkeys([*motifs, *(x.translate(str.maketrans("ACGT", "TGCA"))[::-1] for x in motifs)]))


TELOMERE, CENTROMERE = _both_strands(_TELOMERES), _both_strands(_CENTROMERES)


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names the pattern finds."""
    return df.select(*[c for c in df.columns if re.search(pattern, c)])


def subsample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """A fixed share of the keys with all their rows, the same on every run."""
    space = 1_000_000
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(space)) < int(fraction * space))


def call_twice(track: DataFrame, cutoff: Column | float, **options) -> DataFrame:
    """Segments of a track (call 1), then those of what is left without the runs that they cover (call 2). The first pass is written, as the second starts from it."""
    first = written(segments(track, cutoff, **options), "segments")
    rest = written(interval_anti(track, first), "segments-rest")
    return first.withColumn("call", F.lit(1)).unionByName(segments(rest, cutoff, **options).withColumn("call", F.lit(2)))


def principal_components(wide: DataFrame, name: str, columns: list[str], k: int) -> DataFrame:
    """(name, pc1, ...): rows on the principal components of log1p of their columns; signs are those of the largest loading."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    logged = wide.select(name, *[F.log1p(F.col(c).cast("double")).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(logged)
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(vectors)
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    scores = vector_to_array("_pc")
    return model.transform(vectors).select(name, *[F.round(scores[i] * sign[i], 6).alias(f"pc{i + 1}") for i in range(k)])


def loadings(wide: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, pc1, ...): what each column adds to the principal components of log1p, signs as in principal_components. One row for each column."""
    from pyspark.ml.feature import PCA, VectorAssembler

    logged = wide.select(*[F.log1p(F.col(c).cast("double")).alias(c) for c in columns])
    load = PCA(k=k, inputCol="_v", outputCol="_pc").fit(VectorAssembler(inputCols=columns, outputCol="_v").transform(logged)).pc.toArray()
    sign = [1.0 if load[abs(load[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    rows = [(c, *[float(load[j, i] * sign[i]) for i in range(k)]) for j, c in enumerate(columns)]
    return wide.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"pc{i + 1} double" for i in range(k)))


def motif_tag(name: Column) -> Column:
    """Telomere, centromere or other tandem repeat, by a repeat's motif."""
    return F.when(name.rlike(TELOMERE), "Telomere").when(name.rlike(CENTROMERE), "Centromere").otherwise("Tandem repeats")


#: Bytes of sequences that a caller's function gets at once; a longer sequence comes alone.
BATCH = 4_000_000


def score_sequences(df: DataFrame, score: Callable[[pd.Series], pd.Series], column: str = "seq", batch: int | None = None) -> DataFrame:
    """df with `score`, a caller's function of batches of sequences. Spark's batches count rows, so they are bounded and cut by the bytes of their sequences."""
    import pyarrow as pa
    import pyarrow.compute as pc

    most = batch or BATCH
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            part = pc.cumulative_sum(pc.fill_null(pc.binary_length(rows.column(column)).cast("int64"), 0)).to_numpy() // most
            starts = [i for i in range(len(part)) if not i or part[i] != part[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(part)]):
                few = rows.slice(i, j - i)
                found = score(few.column(column).to_pandas()).to_numpy(float)
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(found, pa.float64(), from_pandas=True)], names=[*few.schema.names, "score"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("score", DoubleType())]))


def terminal_mismatches(bases: DataFrame) -> DataFrame:
    """bases(read_id, seq_pos, base, is_mismatch, length) to (read_id, non_template): the run of mismatches that ends a read, `.` if none.

    A mismatch belongs to the end if as many mismatches follow it as there are positions left.
    """
    from pyspark.sql.window import Window

    after = Window.partitionBy("read_id").orderBy(F.desc("seq_pos")).rowsBetween(Window.unboundedPreceding, 0)
    wrong = bases.where("is_mismatch").withColumn("_n", F.count("*").over(after))
    tail = wrong.where(F.col("_n") == F.col("length") - F.col("seq_pos"))
    found = tail.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_pos", "base"))), lambda x: x["base"]), "").alias("non_template"))
    return bases.select("read_id").distinct().join(found, "read_id", "left").na.fill(".", "non_template")


def interval_sequences(intervals: DataFrame, chunks: DataFrame, key: str = "name", size: int = 10_000) -> DataFrame:
    """intervals with seq from chunks(chrom, chunk, seq) of a fixed size, reverse-complemented on the minus strand."""
    from ..functions.sequence import reverse_complement

    low, high = F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)
    need = intervals.withColumn("chunk", F.explode(F.sequence(low, high)))
    # chunks beyond all intervals are left out where they are read, so they are neither cut out nor shuffled
    first, last = intervals.agg(F.min(low), F.max(high)).first()
    j = need.join(chunks.where(F.col("chunk").between(first, last)), ["chrom", "chunk"])
    lo, hi = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0)), F.least(F.col("end") - F.col("chunk") * size, F.lit(size))
    piece = F.substr("seq", (lo + 1).cast("int"), (hi - lo).cast("int"))
    whole = j.groupBy(key, "chrom", "start", "end", "strand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    return whole.withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")))


def sample_components(counts: DataFrame, gene: str, sample: str, value: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Principal components of log1p of counts(gene, sample, value), samples as rows and genes as columns: scores(sample, pc1, ...) and loadings(gene, pc1, ...) of one fit.

    Values of one cell are summed, missing cells are 0, genes are centred. Genes stay on the cluster:
    what comes to the driver is the matrix of samples by samples, summed up from outer products of
    genes; loadings of all genes are a projection of their rows. Samples are few by design, genes are
    not. Each component's largest score is positive. Components without variance are left out.
    """
    import numpy as np

    names = [r[0] for r in counts.select(sample).where(F.col(sample).isNotNull()).distinct().orderBy(sample).collect()]
    cell = lambda s: F.log1p(F.coalesce(F.sum(F.when(F.col(sample) == s, F.col(value))), F.lit(0)).cast("double"))
    wide = counts.groupBy(gene).agg(F.array(*[cell(s) for s in names]).alias("_x"))
    mean = F.aggregate("_x", F.lit(0.0), lambda a, b: a + b) / len(names)
    wide = written(wide.withColumn("_m", mean).select(gene, F.transform("_x", lambda v: v - F.col("_m")).alias("_x")), "components")
    pairs = wide.select(F.posexplode("_x").alias("i", "v"), "_x").select("i", "v", F.posexplode("_x").alias("j", "w")).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("g"))
    gram = np.zeros((len(names), len(names)))
    for r in pairs.collect():
        gram[r["i"], r["j"]] = r["g"]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    held = values > 1e-12 * max(float(np.trace(gram)), 1e-300)
    values, vectors = values[held], vectors[:, held]
    if len(names):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    columns = [f"pc{i + 1}" for i in range(len(values))]
    scores = [(s, *map(float, vectors[i] * np.sqrt(values))) for i, s in enumerate(names)]
    kind = counts.schema[sample].dataType.simpleString()
    dot = lambda i: F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(v)) for v in vectors[:, i] / np.sqrt(values[i])]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return counts.sparkSession.createDataFrame(scores, ", ".join([f"{sample} {kind}", *[f"{c} double" for c in columns]])), wide.select(gene, *[dot(i).alias(c) for i, c in enumerate(columns)])


def per_group(df: DataFrame, by: list[str], f: Callable[[dict, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A caller's function of each group (its key as a dict, its rows) that returns rows of a schema; by's columns come first in the result.

    A group is in memory as a whole, so groups must be bounded: aggregate before, and group by what
    keeps them small. Null is a group; an empty table has none.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = StructType([*df.select(*by).schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(whole)

    def run(key, rows):
        found = f({c: k.as_py() for c, k in zip(by, key)}, rows.to_pandas())
        cols = [pa.array([k.as_py()] * len(found), t.type) for k, t in zip(key, arrow)]
        cols += [pa.array(found[t.name], t.type, from_pandas=True) for t in list(arrow)[len(by) :]]
        return pa.Table.from_arrays(cols, schema=arrow)

    return df.groupBy(*by).applyInArrow(run, whole)


def whole_groups(df: DataFrame, by: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """As per_group, for very many small groups: a caller's function of batches that hold several groups, each whole, with the columns by; it returns by's columns and those of a schema.

    Rows come in the order of by, so a batch is cut where its last group begins, and that group goes
    on with the next batch. What is in memory is a batch and one group.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = StructType([*df.select(*by).schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(whole)

    def done(batches):
        found = f(pa.Table.from_batches(batches).to_pandas())
        cols = [pa.array(found[t.name], t.type, from_pandas=True) for t in arrow]
        return pa.Table.from_arrays(cols, schema=arrow).to_batches()

    def last_group(batch, key):
        """Where the rows of this key begin at the end of a batch, which is in order."""
        same = None
        for c, v in zip(by, key):
            one = pc.is_null(batch.column(c)) if v is None else pc.fill_null(pc.equal(batch.column(c), v), False)
            same = one if same is None else pc.and_(same, one)
        return batch.num_rows - (pc.sum(same).as_py() or 0)

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[-1].as_py() for c in by]
            cut = last_group(batch, last)
            if cut or (held and key != last):
                if held or cut:
                    yield from done([*held, *([batch.slice(0, cut)] if cut else [])])
                held = []
            held.append(batch.slice(cut))
            key = last
        if held:
            yield from done(held)

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, whole)


def expand(df: DataFrame, columns: list[str], f: Callable[..., Iterator[tuple]], schema: str, keep: list[str]) -> DataFrame:
    """A caller's generator of each row's columns: every tuple it yields is a row of a schema, behind the row's columns keep. Rows of which it yields nothing go."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                found = [(i, row) for i, values in enumerate(zip(*(part.column(c).to_pylist() for c in columns))) for row in f(*values)]
                if found:
                    at = pa.array([i for i, _ in found], pa.int32())
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keep), *(pa.array(v, t.type) for v, t in zip(zip(*(r for _, r in found)), made))], names=[*keep, *made.names])

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(schema).fields]))
