"""Hard negatives by best-first search in an R-tree that Spark packs into shared storage.

Sort-tile-recursive packing: rows are cut into slices of equal counts by one coordinate after the
other until a tile fits a node; each node is packed into leaves likewise and written as a file, and
levels of pages above it hold the minimum bounding boxes of what lies below, down to a root of few
entries. A box bounds each coordinate of its vectors, hence the inner product of any of them with an
anchor from both sides. Anchors are searched in blocks: boxes come from a queue, best bound first; a
box is left out where no anchor of the block needs it, because its interval misses the score window
or its upper end lies strictly below the anchor's kth score.
"""

from __future__ import annotations

import heapq
import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import folder, partitions, scratch, small, stage
from .whitening import coded, matrix

#: Rows of a leaf, and of a node (a file); entries of a page and of the root.
LEAF, NODE, FANOUT = 64, 8_192, 256
#: Slices by one coordinate, and coordinates that tiles are cut by before nodes are dealt by hash.
SLICES, DEPTH = 16, 6
#: Anchors searched together, and rows scored in one step.
ANCHORS, STEP = 1_024, 2_048
#: Places a result has: positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 5

ENTRY = "label_low long, label_high long, path long, name string, node boolean, low binary, high binary"
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


# ---------------------------------------------------------------- packing


def tiled(rows: DataFrame) -> DataFrame:
    """rows(label, row, at) with path and chunk: tiles of about NODE rows of one label by slices of equal counts along `at`, an array of leading coordinates.

    Tiles that ties keep larger are dealt into chunks by hash. What the edges of slices take is a row
    for each tile.
    """
    rows = rows.withColumn("path", F.lit(0).cast("long"))
    for k in range(DEPTH):
        at = F.get("at", k)
        edges = rows.groupBy("label", "path").agg(F.count("*").alias("_n"), F.percentile_approx(at, [i / SLICES for i in range(1, SLICES)], F.lit(10_000)).alias("_edges"))
        edges = stage(edges.where(F.col("_n") > NODE), "negatives-edges")
        if not edges.limit(1).count():
            break
        fine = F.coalesce(F.size(F.filter("_edges", lambda e: e < at)), F.lit(0))
        digit = F.floor(fine * F.least(F.lit(SLICES), F.ceil(F.col("_n") / NODE)) / SLICES)
        rows = rows.join(small(edges), ["label", "path"], "left").withColumn("path", F.col("path") * SLICES + F.coalesce(digit, F.lit(0))).drop("_n", "_edges")
        rows = stage(rows, "negatives-tiles")
    many = stage(rows.groupBy("label", "path").agg(F.ceil(F.count("*") / NODE).alias("_k")).where("_k > 1"), "negatives-large")
    chunk = F.pmod(F.xxhash64("row"), F.coalesce("_k", F.lit(1)))
    return rows.join(small(many), ["label", "path"], "left").withColumn("chunk", chunk).drop("_k")


def str_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows in which runs of so many rows are tiles: slabs of equal counts by one coordinate after the other, widest spread first."""
    tiles = -(-len(x) // leaf)
    if tiles <= 1 or not x.shape[1]:
        return np.arange(len(x))
    depth = min(x.shape[1], max(1, (tiles - 1).bit_length()))
    dims = np.argsort(-x.var(axis=0), kind="stable")[:depth]

    def cut(own: np.ndarray, k: int) -> list[np.ndarray]:
        left = -(-len(own) // leaf)
        if left <= 1 or k == depth:
            return [own]
        slabs = max(2, round(left ** (1 / (depth - k)))) if k < depth - 1 else left
        own = own[np.argsort(x[own, dims[k]], kind="stable")]
        size = -(-left // slabs) * leaf
        return [y for s in range(0, len(own), size) for y in cut(own[s : s + size], k + 1)]

    return np.concatenate(cut(np.arange(len(x)), 0))


def _write(store, at_root: str, **arrays) -> str:
    """One file of arrays. Names are new for each attempt, and only a committed attempt's name is passed on."""
    name, out = uuid.uuid4().hex, io.BytesIO()
    np.savez(out, **arrays)
    with store.open_output_stream(f"{at_root}/{name}", compression=None) as f:
        f.write(out.getbuffer())
    return name


def _read(store, at_root: str, name: str) -> dict[str, np.ndarray]:
    with store.open_input_file(f"{at_root}/{name}") as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


def _store(root: str):
    store, at_root = fs.FileSystem.from_uri(root)
    store.create_dir(at_root, recursive=True)
    return store, at_root


def _entry(labels: tuple[int, int], path: int, name: str, node: bool, low: np.ndarray, high: np.ndarray) -> pa.Table:
    row = [*labels, path, name, node, low.astype(float).tobytes(), high.astype(float).tobytes()]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, types)], _NAMES)


def _node(root: str, size: int):
    """The rows of one node to a file of leaves, and its entry."""

    def run(key, rows):
        x = matrix(rows["x"].combine_chunks(), size)
        order = str_order(x, LEAF)
        x = x[order]
        starts = np.arange(0, len(x), LEAF)
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        packed = x.astype(np.int16) if np.abs(x.astype(float)).max(initial=0) < 1 << 15 else x
        name = _write(*_store(root), x=packed, starts=np.append(starts, len(x)), row=rows["row"].to_numpy()[order], vec_id=rows["vec_id"].to_numpy()[order], low=low, high=high)
        label = key[0].as_py()
        return _entry((label, label), key[1].as_py(), name, True, low.min(axis=0), high.max(axis=0))

    return run


def _page(root: str, size: int):
    """Up to FANOUT entries to a page, and the page's own entry."""

    def run(rows: pa.Table) -> pa.Table:
        e = Entries(rows, size)
        name = _write(*_store(root), label_low=e.label_low, label_high=e.label_high, name=np.array(e.name), node=e.node, low=e.low, high=e.high)
        return _entry((e.label_low.min(), e.label_high.max()), rows["path"][0].as_py(), name, False, e.low.min(axis=0), e.high.max(axis=0))

    return run


class Entries:
    """Boxes of a page or of the root."""

    def __init__(self, rows, size: int):
        if isinstance(rows, pa.Table):
            rows = {c: rows[c].to_pylist() for c in _NAMES}
            rows |= {c: np.frombuffer(b"".join(rows[c]), float).reshape(-1, size) for c in ("low", "high")}
        self.name, self.node = [str(x) for x in rows["name"]], np.array(rows["node"], bool)
        self.label_low, self.label_high = np.array(rows["label_low"], np.int64), np.array(rows["label_high"], np.int64)
        self.low, self.high = np.array(rows["low"]), np.array(rows["high"])


def build(rows: DataFrame, size: int, root: str) -> pa.Table:
    """Pack tiled rows into nodes and pages under root; the root's entries, FANOUT at most, come back."""
    found = stage(rows.select("label", "path", "chunk", "row", "vec_id", "x").groupBy("label", "path", "chunk").applyInArrow(_node(root, size), ENTRY), "negatives-entries")
    while (n := found.count()) > FANOUT:
        order = found.repartitionByRange(max(1, n // (8 * FANOUT)), "label_low", "path", "name").sortWithinPartitions("label_low", "path", "name")
        order = stage(order.withColumn("_i", F.monotonically_increasing_id()), "negatives-order")
        page = order.withColumn("_page", F.struct(F.shiftright("_i", 33).alias("p"), F.floor(F.col("_i").bitwiseAND((1 << 33) - 1) / FANOUT).alias("k")))
        found = stage(page.drop("_i").groupBy("_page").applyInArrow(_page(root, size), ENTRY), "negatives-entries")
    return found.toArrow()


# ---------------------------------------------------------------- search


def merge(scores: np.ndarray, ids: np.ndarray, s: np.ndarray, new: np.ndarray) -> None:
    """Put the best of s (one row for each query, -inf: not wanted) into scores and ids, kept falling, ties by the smaller id."""
    k = scores.shape[1]
    least = scores[:, -1]
    want = (s >= least[:, None]) & (s > -np.inf)
    if want.sum() > 64 * len(s) and s.shape[1] > k:
        want &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]
    q, r = np.nonzero(want)
    if not len(q):
        return
    who, all_s, all_i = np.append(np.repeat(np.arange(len(s)), k), q), np.append(scores.ravel(), s[q, r]), np.append(ids.ravel(), new[r])
    order = np.lexsort((all_i, -all_s, who))
    who, place = who[order], np.arange(len(order))
    first = place - np.maximum.accumulate(np.where(np.append(True, who[1:] != who[:-1]), place, 0))
    keep = first < k
    at = (who[keep], first[keep])
    scores[at], ids[at] = all_s[order][keep], all_i[order][keep]


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exact while they are under 2**53 (by machine words up to 2**63 otherwise)."""
    top = np.abs(q.astype(float)).max(initial=0) * np.abs(x.astype(float)).max(initial=0) * max(1, q.shape[1])
    return q.astype(float) @ x.astype(float).T if top < 2.0**53 else (q @ x.astype(np.int64).T).astype(float)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval of inner products of each q with what lies in each box, widened by what rounding may take."""
    plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    slack = 1e-12 * (np.abs(q.astype(float)) @ np.maximum(np.abs(low), np.abs(high)).T)
    return plus @ low.T + minus @ high.T - slack, plus @ high.T + minus @ low.T + slack


class Search:
    """One block of anchors over the tree."""

    def __init__(self, root: str, size: int, top: Entries):
        self.store, self.at_root = _store(root)
        self.size, self.top, self.read = size, top, {}

    def queue(self, q: np.ndarray, label_fits, wanted, visit) -> None:
        """Boxes best bound first. label_fits(low, high): which anchors such labels concern; wanted(low, high): how far each anchor wants scores of such an interval (-inf: not at all); visit(node, anchors)."""
        heap, n = [], 0

        def push(e: Entries) -> None:
            nonlocal n
            low, high = bounds(q, e.low, e.high)
            for i in range(len(e.name)):
                fits = label_fits(e.label_low[i], e.label_high[i])
                reach = np.where(fits, wanted(low[:, i], high[:, i]), -np.inf)
                if reach.max(initial=-np.inf) > -np.inf:
                    heapq.heappush(heap, (-reach.max(), n, e.name[i], bool(e.node[i]), low[:, i], high[:, i], fits))
                    n += 1

        push(self.top)
        while heap:
            _, _, name, node, low, high, fits = heapq.heappop(heap)
            live = np.flatnonzero(fits & (wanted(low, high) > -np.inf))
            if not len(live):
                continue
            page = _read(self.store, self.at_root, name)
            if node:
                self.read[name] = self.read.get(name, 0) + len(live)
                visit(page, live)
            else:
                push(Entries(page, self.size))

    def leaves(self, page: dict, q: np.ndarray, wanted, score) -> None:
        """Steps of STEP rows of one node's leaves, best bound first; wanted(low, high): as in queue, for leaves; score(rows)."""
        low, high = bounds(q, page["low"], page["high"])
        reach = wanted(low, high).max(axis=0)
        order = np.argsort(-reach, kind="stable")
        starts = page["starts"]
        each = max(1, STEP // max(1, int(starts[1])))
        for at in range(0, len(order), each):
            own = order[at : at + each]
            own = own[wanted(low[:, own], high[:, own]).max(axis=0) > -np.inf]
            if len(own):
                score(np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own]))

    def positives(self, q: np.ndarray, row: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        reach = lambda low, high, least: np.where(high >= (least if high.ndim == 1 else least[:, None]), high, -np.inf)

        def visit(page, live):
            def score(rows):
                s = product(q[live], page["x"][rows])
                s[row[live][:, None] == page["row"][rows][None, :]] = -np.inf
                a, b = scores[live], ids[live]
                merge(a, b, s, page["vec_id"][rows])
                scores[live], ids[live] = a, b

            self.leaves(page, q[live], lambda low, high: reach(low, high, scores[live, -1]), score)

        self.queue(q, lambda low, high: (label >= low) & (label <= high), lambda low, high: reach(low, high, scores[:, -1]), visit)
        return scores, ids

    def negatives(self, q: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window low[a, w]..high[a, w] of an anchor its k best rows of other labels."""
        windows = low.shape[1]
        scores, ids = np.full((len(q), windows, k), -np.inf), np.full((len(q), windows, k), np.iinfo(np.int64).max)

        def reach(own, box_low, box_high):
            out = np.full(box_high.shape, -np.inf)
            for w in range(windows):
                least, most = np.maximum(low[own, w], scores[own, w, -1]), high[own, w]
                if box_high.ndim == 2:
                    least, most = least[:, None], most[:, None]
                hit = (least <= most) & (box_high >= least) & (box_low <= most)
                out = np.where(hit, np.maximum(out, np.minimum(box_high, most)), out)
            return out

        def visit(page, live):
            def score(rows):
                s = product(q[live], page["x"][rows])
                for w in range(windows):
                    a, b = scores[live, w], ids[live, w]
                    merge(a, b, np.where((s >= low[live, w][:, None]) & (s <= high[live, w][:, None]), s, -np.inf), page["vec_id"][rows])
                    scores[live, w], ids[live, w] = a, b

            self.leaves(page, q[live], lambda box_low, box_high: reach(live, box_low, box_high), score)

        every = np.arange(len(q))
        self.queue(q, lambda a, b: ~((label == a) & (label == b)), lambda box_low, box_high: reach(every, box_low, box_high), visit)
        return scores, ids


FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _mine(root: str, size: int, top: pa.Table, least: int):
    """Anchors to their hard negatives, in blocks; least: hundredths of the positive's score that a negative reaches at least."""

    def block(rows: pa.Table, tree: Search) -> pa.RecordBatch:
        q, label = matrix(rows["x"].combine_chunks(), size), rows["label"].to_numpy()
        positive, positive_id = tree.positives(q, rows["row"].to_numpy(), label, POSITIVES)
        real = positive > -np.inf
        high = np.where(real, positive, -np.inf)
        low = np.where(real, -(-least * np.where(real, positive, 0).astype(np.int64) // 100), np.inf)
        score, found = tree.negatives(q, label, low, high, NEGATIVES)
        a, w, k = np.nonzero(score > -np.inf)
        cols = [rows["vec_id"].to_numpy()[a], positive_id[a, w], (k + 1).astype(np.int32), found[a, w, k], positive[a, w].astype(np.int64), score[a, w, k].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in FOUND.split(", ")])

    def run(batches):
        tree, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                held.append(batch.slice(at, ANCHORS))
                if sum(x.num_rows for x in held) >= ANCHORS:
                    tree = tree or Search(root, size, Entries(top, size))
                    yield block(pa.Table.from_batches(held), tree)
                    held = []
        if held:
            yield block(pa.Table.from_batches(held), tree or Search(root, size, Entries(top, size)))

    return run


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, scale: int = 256, least: int = 80) -> DataFrame:
    """vectors(vec_id, embedding, ...): for each anchor and each of its positives the hard negatives.

    Entries become floor(scale * x); scores are integer inner products, exact up to 2**53; higher ones
    come first, ties by the smaller vec_id. An anchor's positives are its POSITIVES best other rows of
    its label; a positive's negatives the NEGATIVES best rows of other labels whose score is at most
    the positive's and at least `least` hundredths of it, so there are none for a negative score.
    label and is_anchor are columns over vectors' columns.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows with null
    vec_id, label or vector, or a null or non-finite entry take no part. Vectors of different lengths
    are not compared. Rows that repeat a vec_id are rows of their own: copies of an anchor are its
    positives, and each anchor among them has its own results. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    with scratch(spark, "hard-negatives"):
        own = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).cast("long").alias("anchor"), "embedding").where("label IS NOT NULL")
        lead = [F.coalesce(F.floor(F.get("embedding", k).cast("double") * scale), F.lit(0)).alias(f"at{k}") for k in range(DEPTH)]
        keep = ("vec_id", "label", "anchor", *[f"at{k}" for k in range(DEPTH)])
        rows = coded(own.select("vec_id", "label", "anchor", "embedding", *lead), scale, keep)
        rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", "size", "x", F.array(*[f"at{k}" for k in range(DEPTH)]).alias("at")), "negatives-rows")
        out = spark.createDataFrame([], FOUND)
        for r in rows.groupBy("size").agg(F.sum("anchor").alias("anchors")).collect():
            size, anchors = r["size"], r["anchors"]
            if not size or not anchors:
                continue
            root = folder(spark, "negatives-tree")
            tree = stage(tiled(rows.where(F.col("size") == size)), "negatives-tiled")
            top = build(tree, size, root)
            blocks = max(1, min(4 * partitions(spark), anchors // 16), -(-anchors // ANCHORS))
            asked = tree.where("anchor = 1").select("row", "vec_id", "label", "path", "x").repartitionByRange(blocks, "label", "path", "row")
            out = out.union(asked.select("row", "vec_id", "label", "x").mapInArrow(_mine(root, size, top, least), FOUND))
        return stage(out, "hard-negatives")
