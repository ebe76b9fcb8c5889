"""Histogram sort: shards of near equal bytes, cut out of one global order by exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stage

#: Bits of the key that one round of counting tells apart.
RADIX_BITS = 12
#: Digits of a key: 60 bits of the text's hash, then 60 bits of the document's.
DIGITS = 10
#: Ranges that the shards are dealt in, for each shuffle partition; and the most of them, so that one
#: round of counting finds their boundaries.
RANGES_PER_PARTITION, MOST_RANGES = 4, 1 << RADIX_BITS


def _digit(k: int) -> Column:
    source, at = ("h", k) if k < DIGITS // 2 else ("d", k - DIGITS // 2)
    return F.shiftrightunsigned(F.shiftleft(F.col(source), RADIX_BITS * at), 64 - RADIX_BITS).cast("long")


def splitters(rows: DataFrame, targets: list[int], tolerance: int) -> list[tuple[int, ...]]:
    """For each target the key prefix (digits) below which the bytes come within tolerance of it.

    rows(h, d, size). Each round counts the exact bytes in every cell of the open intervals (the
    cells that hold a target which no boundary has met yet), one digit of the key finer. The driver
    sees at most 2**RADIX_BITS sums for each target and round. If a cell holds one row, or the key
    has no more digits, the nearer end of the cell is taken.
    """
    met: dict[int, tuple[int, ...]] = {}
    open_cells: dict[tuple[int, ...], int] = {(): 0}  # prefix -> bytes below it
    for k in range(DIGITS):
        prefixes = sorted(open_cells)
        cell = F.concat_ws(",", *[_digit(j) for j in range(k)]) if k else F.lit("")
        inside = rows if not k else rows.where(cell.isin([",".join(map(str, p)) for p in prefixes]))
        counted = inside.groupBy(cell.alias("cell"), _digit(k).alias("digit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        by: dict[tuple[int, ...], list[tuple[int, int, int]]] = {p: [] for p in prefixes}
        for r in counted:
            by[tuple(map(int, r["cell"].split(","))) if r["cell"] else ()].append((r["digit"], r["bytes"], r["n"]))
        nxt: dict[tuple[int, ...], int] = {}
        for p in prefixes:
            below = open_cells[p]
            for digit, size, n in sorted(by[p]):
                for i, t in enumerate(targets):
                    if i in met or not below <= t < below + size:
                        continue
                    low, high = t - below, below + size - t
                    after = p + (digit + 1,)
                    if min(low, high) <= tolerance or n == 1 or k == DIGITS - 1:
                        met[i] = p + (digit,) if low <= high else after
                    else:
                        nxt[p + (digit,)] = below
                below += size
        open_cells = nxt
        if not open_cells:
            break
    return [met.get(i, (1 << RADIX_BITS,)) for i in range(len(targets))]


def _unsigned(digits: tuple[int, ...]) -> tuple[int, int]:
    """A prefix as the two 60-bit numbers of the smallest key at or above it."""
    n = 0
    for k in range(DIGITS):
        n = (n << RADIX_BITS) + (digits[k] if k < len(digits) else 0)  # a digit of 2**RADIX_BITS carries over
    half = RADIX_BITS * DIGITS // 2
    return n >> half, n & ((1 << half) - 1)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """docs(doc_id, text) dealt into shards of near equal bytes (law `bytes`).

    Size: the text's UTF-8 bytes (null: none) plus 1. All rows are put in one order by (hash of the
    text, hash of doc_id), so that equal texts lie side by side and a group of them is cut only
    where a boundary has to fall into it. Boundaries come from counting (see splitters) until each
    is within tolerance * bytes of a shard; then one exchange deals the rows out. slot: the row's
    place in its shard from 0 without gaps. text_crc32 is that of the text's bytes (null: of none).
    Rows that agree in text and doc_id cannot be told apart by the key and stay in one shard; they
    still get different slots. Null doc_id and null text are keys of their own. An empty table gives
    no rows. Other columns are ignored.
    """
    half = 64 - RADIX_BITS * DIGITS // 2
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        F.xxhash64("doc_id", F.lit(7)).alias("d"),
    )
    keyed = stage(keyed, "shard-keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, min(RANGES_PER_PARTITION * partitions(docs.sparkSession), MOST_RANGES) // shards)
    tol = max(1, int(tolerance * total / shards))
    cuts = splitters(keyed, [total * i // shards for i in range(1, shards)], tol)
    fine = splitters(keyed, [total * i // (shards * ranges) for i in range(1, shards * ranges) if i % ranges], int(0.5 * total / (shards * ranges)))
    key = F.struct(F.shiftrightunsigned("h", half).alias("a"), F.shiftrightunsigned("d", half).alias("b"))
    cuts, fine = sorted(map(_unsigned, cuts)), sorted(set(map(_unsigned, [*cuts, *fine])))
    # every range of the fine cut lies in one shard
    keyed = keyed.withColumn("key", key).withColumn("piece", _above(fine)).withColumn("shard", _above(cuts).cast("int"))
    n = keyed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).select("piece", "before")
    place = F.row_number().over(Window.partitionBy("piece").orderBy("key", "doc_id"))
    dealt = keyed.select("doc_id", "size", "text_crc32", "key", "shard", "piece", place.alias("place"))
    return dealt.join(F.broadcast(before), "piece").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _above(cuts: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below a row's key: those of its first digit from a table, the rest compared."""
    first = [a >> (RADIX_BITS * DIGITS // 2 - RADIX_BITS) for a, _ in cuts]
    table = [[(a, b) for (a, b), f in zip(cuts, first) if f == digit] for digit in range(1 << RADIX_BITS)]
    base = [sum(f < digit for f in first) for digit in range(1 << RADIX_BITS)]
    bounds = F.from_json(F.lit("[" + ",".join("[" + ",".join(f'{{"a":{a},"b":{b}}}' for a, b in row) + "]" for row in table) + "]"), "array<array<struct<a:bigint,b:bigint>>>")
    bases = F.from_json(F.lit(str(base)), "array<bigint>")
    at = (F.shiftrightunsigned(F.col("h"), 64 - RADIX_BITS) + 1).cast("int")
    return F.element_at(bases, at) + F.size(F.filter(F.element_at(bounds, at), lambda x: x <= F.col("key")))
