"""Exact top-k search by inner product with multi-resolution segment statistics.

For vectors cut into segments, q.x is at most the sum over segments of len * mean * mean plus
deviation * deviation (equivalently: segment means and deviations bound the distance from below).
Bounds are taken coarse to fine; what can still be among the k best is scored exactly. A first pass
over a few rows gives each query a score that its k best reach at least, so that every block of rows
starts with a threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stage

#: Segments of the resolutions, coarse to fine.
RESOLUTIONS = (1, 4, 16)
#: Rows and queries of one block of the grid.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048
#: Rows of each length of vectors, about, that the first pass scores; they only set thresholds.
FIRST_ROWS = 4_096


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of scaled means and deviations, so that the product of two rows bounds the inner product from above."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for s, e in zip(edges[:-1], edges[1:]):
        part = x[:, s:e]
        mean = part.mean(axis=1)
        out += [mean * math.sqrt(e - s), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def best(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows of a block, ties to the smaller id; own[i]: the query's row in the block, or -1; floor[i]: scores below are not wanted."""
    levels = [(statistics(queries, n), statistics(rows, n)) for n in RESOLUTIONS if n < max(2, rows.shape[1])]
    slack = 1e-9 * (np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0)) + 0.5
    out_q, out_r, out_s = [], [], []
    coarse = levels[0][0] @ levels[0][1].T
    for i in range(len(queries)):
        bound = coarse[i]
        if own[i] >= 0:
            bound[own[i]] = -np.inf
        least = -np.inf if floor is None else floor[i] - slack[i]
        live = np.flatnonzero((bound > -np.inf) & (bound >= least))
        if len(live) > k:
            guess = live[np.argpartition(-bound[live], k - 1)[:k]]
            reach = max(least, np.sort(rows[guess] @ queries[i])[-k] - slack[i])
            live = live[bound[live] >= reach]
            for q, r in levels[1:]:
                finer = r[live] @ q[i]
                guess = live[np.argpartition(-finer, min(k, len(live)) - 1)[:k]]
                reach = max(reach, np.sort(rows[guess] @ queries[i])[-min(k, len(guess))] - slack[i]) if len(guess) == k else reach
                live = live[finer >= reach]
        score = rows[live] @ queries[i]
        first = np.lexsort((ids[live], -score))[:k]
        out_q.append(np.full(len(first), i)), out_r.append(live[first]), out_s.append(score[first])
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (out_q, out_r, out_s))


def _matrix(col: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int64).reshape(len(col), size).astype(np.float64) if size else np.zeros((len(col), 0))


FOUND = "query_row long, query_id long, vec_id long, score long"


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64)] * 4
        if len(rows) and len(queries):
            size = rows["size"][0].as_py()
            place = {r: i for i, r in enumerate(rows["row"].to_pylist())}
            asked, ids = queries["query_row"].to_numpy(), rows["vec_id"].to_numpy()
            own = np.array([place.get(r, -1) for r in asked])
            q, r, s = best(_matrix(queries["query"], size), _matrix(rows["vec"], size), own, ids, k, queries["floor"].to_numpy())
            cols = [asked[q], queries["query_id"].to_numpy()[q], ids[r], s.astype(np.int64)]
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in cols))))

    return run


def _pack(batches):
    for batch in batches:
        vec = batch.column("vec").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array([len(v) for v in vec], pa.int32()), pa.array([np.array(v, np.int64).tobytes() for v in vec], pa.binary())], ["row", "vec_id", "size", "vec"])


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """vectors(vec_id, embedding): for each row with is_query (a column) its k best other rows.

    Components become floor(scale * x); the score is the integer inner product, exact up to 2**53.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Rows whose vector
    is null or has a null or non-finite component take no part, nor do null vec_ids. Vectors of
    different lengths are not compared. Rows that repeat a vec_id are rows of their own: each is a
    candidate for the others, and queries among them give a list each. Work is dealt out as a grid of
    row blocks by query blocks, so no task holds more than one block of each.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fine)
    coded = whole.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
    coded = stage(coded.mapInArrow(_pack, "row long, vec_id long, size int, vec binary"), "topk")
    counts = {r["size"]: (r["n"], r["q"]) for r in coded.groupBy("size").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}
    most = max((n for n, _ in counts.values()), default=1)
    asked = max((q for _, q in counts.values()), default=1)
    g, h = -(-most // BLOCK_ROWS), max(1, -(-asked // BLOCK_QUERIES))
    mine = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    def search(rows: DataFrame, queries: DataFrame, g: int) -> DataFrame:
        rows = rows.select("*", mine(g).alias("g"), every(h).alias("h"))
        queries = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("size").alias("size"), F.col("vec").alias("query"), "floor", mine(h).alias("h"), every(g).alias("g"))
        return rows.groupBy("size", "g", "h").cogroup(queries.groupBy("size", "g", "h")).applyInArrow(_search(k), FOUND)

    queries = coded.where(is_query)
    if g > 1:  # else the one block of rows finds its thresholds itself
        some = coded.where(F.pmod(F.xxhash64(F.col("row") + 1), F.lit(-(-most // FIRST_ROWS))) == 0)
        reached = search(some, queries.withColumn("floor", F.lit(float("-inf"))), 1).groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
        reached = stage(reached.where(F.col("n") >= k).select("row", F.col("least").alias("floor")), "topk-first")
        queries = queries.join(small(reached), "row", "left")
    else:
        queries = queries.withColumn("floor", F.lit(None).cast("double"))
    found = search(coded, queries.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), g)
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
