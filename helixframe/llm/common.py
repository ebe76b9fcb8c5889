"""Shared helpers: reading tables, staging intermediate results, and hashing text with numpy."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is cut at white space.
BLOCK = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH = 4 << 20
#: Rows up to which a table of plain ids may be broadcast (about 32 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Bits of a map of hashes (2 MB); more hashes let more of others through, none of its own is lost.
MAP_BITS = 1 << 24
#: The temporary folder of this process, for a local master without spark.checkpoint.dir.
_local: dict[str, str] = {}
#: Names and paths of what was staged inside each open scratch().
_held: list[list[tuple[str, str]]] = []


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH bytes from here on, so that rows with long texts do not pile up in a task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, for a local master only, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _local.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='spark-')}") if not _local else _local["dir"]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that an open scratch() deletes at its end."""
    path = new_path(spark, name)
    if _held:
        _held[-1].append((name, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Whatever is staged inside, but for these names, is deleted at the end; an outer scratch sees to what is kept."""
    held: list[tuple[str, str]] = []
    _held.append(held)
    try:
        yield
    finally:
        _held.remove(held)
    if _held:
        _held[-1] += [x for x in held if x[0] in keep]
    for path in (p for name, p in held if name not in keep):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def small_bytes(df: DataFrame, size: Column, most: int) -> DataFrame:
    """df marked for broadcast if its rows, each of so many bytes (a column), come to at most that many; otherwise as it is."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most else df


def trim() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function over batches that hands memory it has freed back to the system at its end: workers live on between stages."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


# ---------------------------------------------------------------- numpy hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = x + _G
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def bitmap(seeds: DataFrame) -> np.ndarray:
    """The map of a column seed: MAP_BITS bits, put together by Spark; at most MAP_BITS / 64 rows come to the driver."""
    bit = F.pmod("seed", F.lit(MAP_BITS))
    rows = seeds.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(seed, {MAP_BITS}) % 64 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def in_map(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (seeds.view(np.int64) % MAP_BITS).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


_BASE = 0x2545F4914F6CDD1D
_TABLE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            m = min(done, size - done)
            with np.errstate(over="ignore"):
                have[done : done + m] = have[:m] * step
            done += m
        _powers[base] = have
    return have[:n]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return o - o[0], d[o[0] : o[-1]]


def words(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words between white space of texts that lie end to end, A-Z lower-cased.

    Returns for each word its text's number, its first byte's place in data, and a 64-bit hash.
    Works in blocks cut at white space, so that memory stays bounded however long a text is.
    """
    docs, starts_all, hashes = [], [], []
    edge = np.unique(offsets)
    at, end_all = 0, len(data)
    while at < end_all:
        end = min(at + BLOCK, end_all)
        if end < end_all:
            k = np.searchsorted(edge, end, "right") - 1
            cut = int(edge[k]) if edge[k] > at else 0
            if not cut:
                back = np.flatnonzero(space[data[at:end]])
                cut = at + int(back[-1]) + 1 if len(back) else 0
            while not cut:
                ahead = np.flatnonzero(space[data[end : end + BLOCK]])
                nxt = int(edge[min(np.searchsorted(edge, end, "left"), len(edge) - 1)])
                if len(ahead):
                    cut = min(end + int(ahead[0]) + 1, max(nxt, end + 1) if nxt > end else end + int(ahead[0]) + 1)
                elif end + BLOCK >= end_all:
                    cut = nxt if at < nxt else end_all
                else:
                    end += BLOCK
                    cut = nxt if at < nxt <= end else 0
            end = cut
        part = data[at:end]
        word = ~space[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = edge[(edge > at) & (edge < end)] - at
        first[inner] = word[inner]
        s = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[inner - 1] = word[inner - 1]
        e = np.flatnonzero(last) + 1
        if len(s):
            with np.errstate(over="ignore"):
                total = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(_TABLE[_LOWER[part]] * _power(_BASE, len(part)), out=total[1:])
                h = (total[e] - total[s]) * _power(pow(_BASE, -1, 1 << 64), len(part))[s]
                hashes.append(mix(h + (e - s).astype(np.uint64) * _M2))
            docs.append(np.searchsorted(offsets, s + at, "right") - 1)
            starts_all.append(s + at)
        at = end
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(starts_all), np.concatenate(hashes)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place of h on, where n words are left."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * np.uint64(_BASE) + h[j : len(h) - n + 1 + j]
        return mix(out)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text each."""
    offsets, _ = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to
