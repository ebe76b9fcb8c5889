"""Text files read by byte ranges, as a Spark data source: lines with their places, FASTQ records, pieces of FASTA records.

A file is cut into ranges of so many bytes, each a partition. A line or record belongs to the range
in which its first byte lies; a range that begins inside one looks for the next. Compressed files
(.gz) are one range. Paths are local ones or URIs that pyarrow.fs opens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

#: Bytes of a range, of one read, and bases of a piece of a FASTA record.
RANGE, READ, PIECE = 64 << 20, 1 << 20, 1 << 16
#: Rows, and bytes of text, of one batch.
ROWS, TEXT = 10_000, 4 << 20

SCHEMAS = {
    "lines": "path string, part long, at long, line long, value string",
    "fastq": "path string, part long, at long, head string, seq string, qual string",
    "fasta": "path string, part long, k long, record long, head string, first long, bases long, seq string",
}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder but hidden ones."""
    store, at = _open(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    kept = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith((".", "_")))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return [(scheme + p if scheme else p, n) for p, n in kept]


def lines(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that begin in a range and of those after it, as long as they are asked for."""
    store, at = _open(path)
    if path.endswith(".gz"):
        with store.open_input_stream(at, compression="gzip") as f:
            yield from _cut(lambda: f.read(READ), 0)
        return
    with store.open_input_file(at) as f:
        begin = max(start - 1, 0)
        f.seek(begin)
        found = _cut(lambda: f.read(READ), begin)
        if start:
            next(found, None)  # the rest of a line that begins before the range
        yield from found


def _cut(read, place: int) -> Iterator[tuple[int, str]]:
    rest: list[bytes] = []
    while block := read():
        parts = block.split(b"\n")
        for part in parts[:-1]:
            line = b"".join([*rest, part])
            rest = []
            yield place, line.removesuffix(b"\r").decode()
            place += len(line) + 1
        rest.append(parts[-1])
    if last := b"".join(rest):
        yield place, last.removesuffix(b"\r").decode()


def _lines(r: Range) -> Iterator[tuple]:
    for n, (at, line) in enumerate(lines(r.path, r.start, r.end), 1):
        if at >= r.end:
            return
        yield r.path, r.start, at, None if r.start else n, line


def _fastq(r: Range) -> Iterator[tuple]:
    """Records of four lines. A header is told by its `@` and the `+` two lines on: no line but a header has that."""
    held: list[tuple[int, str]] = []
    for at, line in lines(r.path, r.start, r.end):
        if not held and (at >= r.end or not line.strip()):
            if at >= r.end:
                return
            continue
        held.append((at, line))
        if held[0][0] >= r.end:
            return
        if len(held) == 4:
            if held[0][1].startswith("@") and held[2][1].startswith("+"):
                if len(held[1][1]) != len(held[3][1]):
                    raise ValueError(f"{r.path}: the record at byte {held[0][0]} has {len(held[1][1])} bases and {len(held[3][1])} qualities")
                yield r.path, r.start, held[0][0], held[0][1][1:], held[1][1], held[3][1]
                held = []
            elif r.start:
                held.pop(0)
            else:
                raise ValueError(f"{r.path}: no record at byte {held[0][0]}")
    if held and not r.start or len(held) == 4:
        raise ValueError(f"{r.path}: the last record at byte {held[0][0]} is cut off")


def _fasta(r: Range) -> Iterator[tuple]:
    """Pieces of sequence with where they begin in their record; of a record that began before the range, where they begin in the range (record and head null). A header counts at a line's start only."""
    record, head, first, held, k, bases = None, None, 0, [], 0, 0

    def piece():
        nonlocal first, held, k, bases
        row = (r.path, r.start, k, record, head, first, bases, "".join(held))
        first, held, k, bases = first + bases, [], k + 1, 0
        return row

    for at, line in lines(r.path, r.start, r.end):
        if at >= r.end:
            break
        if line.startswith(">"):
            if held:
                yield piece()
            record, head, first = at, line[1:], 0
            yield piece()  # the record itself, even if it has no sequence
            continue
        text = "".join(line.split())
        held.append(text)
        bases += len(text)
        if bases >= PIECE:
            yield piece()
    if held:
        yield piece()


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.kind, self.schema = options["path"], options["kind"], schema
        self.bytes = int(options.get("bytes", RANGE))

    def partitions(self) -> list[Range]:
        return [Range(p, s, n if p.endswith(".gz") else min(s + self.bytes, n)) for p, n in files(self.path) for s in (range(0, max(n, 1), self.bytes) if not p.endswith(".gz") else [0])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, size = to_arrow_schema(self.schema), [], 0
        if partition.path.endswith(".gz"):
            partition = Range(partition.path, 0, 1 << 62)
        for row in {"lines": _lines, "fastq": _fastq, "fasta": _fasta}[self.kind](partition):
            rows.append(row)
            size += len(row[-1])
            if len(rows) >= ROWS or size >= TEXT:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options), schema)


def read_ranges(spark: SparkSession, path: str, kind: str, size: int = RANGE) -> DataFrame:
    """kind: a key of SCHEMAS; size: bytes of a range."""
    spark.dataSource.register(RangeSource)
    return spark.read.format("text_ranges").option("kind", kind).option("bytes", str(size)).load(path)


def fasta_pieces(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, record, head, first, bases, seq): pieces of records with where they begin; record: the byte of its header.

    What a range hands on to the next is a row for each range: the record it ends in, and its bases so
    far. Text before the first header of a file is left out.
    """
    rows = read_ranges(spark, path, "fasta", size)
    ends = rows.groupBy("path", "part").agg(F.max_by(F.struct("record", "head", (F.col("first") + F.col("bases")).alias("upto")), "k").alias("e"))
    order = Window.partitionBy("path").orderBy("part")
    ends = ends.withColumn("n", F.count("e.record").over(order))  # ranges without a header go on with the record of those before
    ends = ends.withColumn("upto", F.sum("e.upto").over(Window.partitionBy("path", "n").orderBy("part")))
    last = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # a range without any line that begins in it has no row; what is handed on skips it
    carry = ends.select("path", "part", last(F.col("e.record")).alias("r"), last(F.col("e.head")).alias("h"), F.lag("upto").over(order).alias("u"))
    out = rows.join(carry, ["path", "part"])
    own = F.col("record").isNotNull()
    first = F.when(own, F.col("first")).otherwise(F.col("first") + F.col("u"))
    return out.select("path", F.coalesce("record", "r").alias("record"), F.when(own, F.col("head")).otherwise(F.col("h")).alias("head"), first.alias("first"), "bases", "seq").where("record IS NOT NULL")


def read_fasta_chunks(spark: SparkSession, path: str, chunk: int = 10_000, size: int = RANGE) -> DataFrame:
    """(chrom, chunk, seq) of FASTA: each record's sequence in chunks of so many bases (the last may be shorter), so that no chromosome is one row."""
    pieces = fasta_pieces(spark, path, size).where("bases > 0")
    each = pieces.select("path", "record", F.split_part("head", F.lit(" "), F.lit(1)).alias("chrom"), "first", "bases", "seq", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor((F.col("first") + F.col("bases") - 1) / chunk))).alias("chunk"))
    lo, hi = F.greatest(F.col("chunk") * chunk - F.col("first"), F.lit(0)), F.least((F.col("chunk") + 1) * chunk - F.col("first"), F.col("bases"))
    part = F.struct(F.greatest("first", F.col("chunk") * chunk).alias("at"), F.substr("seq", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    whole = each.groupBy("path", "record", "chrom", "chunk").agg(F.array_sort(F.collect_list(part)).alias("l"))
    return whole.select("chrom", "chunk", F.array_join(F.transform("l", lambda x: x["s"]), "").alias("seq"))
