"""Exact near-duplicate join of word n-gram sets by partition signatures (part enumeration).

Sets of like size fall into a scheme: overlapping size bands, so that any two sets which can be
similar enough share one. If two sets of sizes a <= b have Jaccard similarity t or more, they differ
in at most k = (a + b) * (1 - t) / (1 + t) elements. A scheme splits the domain of n-grams into parts
and takes fingerprints of subsets of a set's parts, such that similar sets share one. Which subsets
are the cheapest depends on the band:

- Small sets (ENUM_FROM to ENUM elements): every element is a part, and the subsets are all those of
  the size that a pair of sizes must have in common. They are few, and hardly any other set has them.
- Larger sets: the domain is split into N parts by a hash, and the subsets are single parts. k
  differences spoil at most k parts; so a set with more than k non-empty parts shares one with each
  similar set. More parts to a subset would need more parts in all, and no fewer signatures. In bands
  up to SINGLE each element is a part, so that parts cannot be too few; a set that has too few in a
  larger band is compared with all sets that share an n-gram with it.

Signatures of more than HOT sets are never expanded into pairs. A set that keeps more than k other
("cold") signatures finds all its partners by these. For two sets that both lack them, every part
in which they agree is hot; so they share one of their (k - cold + 1) rarest hot signatures (small
sets: one of their hot ones). These groups are compared with their most ordinary member first and
components are merged; what is known of each signature is joined to its members by broadcast, if there
are few signatures, so that no signature's members meet in one task. What then still lies in different components drops out if it has too few
n-grams in common with all others; the rest is compared block by block, without a row for any pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bitmap, in_map, mix, ngrams, partitions, scratch, slices, small, stage, text_buffers, trim, trimmed, words
from .components import components

#: A signature of more than so many different sets is hot: its group is compared by stars, not by pairs.
HOT = 16
#: Signatures that a task packs at once.
PACK = 500_000
#: Sets, and elements of sets, of one block when clusters of hot groups are compared.
BLOCK, BLOCK_ELEMENTS = 2_048, 2_000_000
#: Sets of a block that are held against each other as one matrix.
SUB = 512
#: Pairs that a task holds before it passes them on.
HELD_PAIRS = 1_000_000
#: Sizes of the bands: scheme g holds sizes from STEP**g to STEP**g * STEP * 4/3.
STEP = 2.0
#: The last scheme whose parts are single elements. In larger ones, parts are expected to outnumber the
#: differences by six standard deviations or more.
SINGLE = 5
#: Parts for each element of a scheme's largest set.
DENSITY = 0.45
#: The scheme of small sets, whose subsets are enumerated, and the sizes of which the smaller of two must be. (Up to ENUM they have about as many signatures as elements.)
SMALL, ENUM_FROM, ENUM = 30, 4, 6

_ALL, _LOW40, _SCHEME = (1 << 64) - 1, np.uint64((1 << 40) - 1), np.uint64(31)


def sets(batch: pa.RecordBatch, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text with at least one word."""
    doc, _, h = words(*text_buffers(batch.column("text")))
    if not len(h):
        return
    bounds = np.flatnonzero(np.diff(doc)) + 1
    grams = ngrams(h, n)
    for s, e in zip(np.r_[0, bounds], np.r_[bounds, len(h)]):
        if e - s >= n:
            yield int(doc[s]), np.unique(grams[s : e - n + 1])
        else:
            yield int(doc[s]), mix(ngrams(h[s:e], int(e - s)) + np.uint64(e - s))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s).sum().view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def schemes(size: int, t: float) -> list[int]:
    """The schemes that a set of this size takes part in."""
    g = int(np.floor(np.log(size) / np.log(STEP) + 1e-9))
    while STEP**g > size:
        g -= 1
    while STEP ** (g + 1) <= size:
        g += 1
    bands = [g - 1, g] if g and size <= STEP**g / t else [g]
    if ENUM_FROM <= size <= ENUM:  # a band is only needed for partners that are smaller yet
        bands = [x for x in bands if STEP**x < ENUM_FROM and ENUM_FROM - 1 >= t * size]
    return bands + ([SMALL] if ENUM_FROM <= size <= ENUM / t else [])


def parts(scheme: int, t: float) -> int:
    """The number of parts; 0: every element is a part of its own, so that a set has more parts than differences for certain."""
    top = STEP ** (scheme + 1) / t
    return int(np.ceil(top * DENSITY * (1 - t) / 0.25)) + 8 if scheme > SINGLE else 0


def differences(size: int, t: float) -> int:
    """The most elements in which a set of this size can differ from a similar set (of size / t at most)."""
    return int(np.floor((size + size / t) * (1 - t) / (1 + t) + 1e-9))


def _part(s: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return s
    with np.errstate(over="ignore"):
        return (mix(s * np.uint64(3)) >> np.uint64(11)) % np.uint64(n)


def common_sizes(size: int, t: float) -> list[int]:
    """What a set of this size and a similar one must have in common, for all sizes of partners in the scheme of small sets."""
    partners = [p for p in range(ENUM_FROM, int(size / t + 1e-9) + 1) if p >= t * size - 1e-9 and min(p, size) <= ENUM]
    return sorted({int(np.ceil(t * (size + p) / (1 + t) - 1e-9)) for p in partners})


def signatures(s: np.ndarray, scheme: int, t: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        if scheme == SMALL:
            h = mix(s)
            return np.concatenate([mix(h[np.array(list(itertools.combinations(range(len(s)), m)))].sum(axis=1) + np.uint64((SMALL << 40) + m)) for m in common_sizes(len(s), t)])
        p = _part(s, parts(scheme, t))
        order = np.argsort(p, kind="stable")
        p = p[order]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        return mix(np.add.reduceat(mix(s[order]), first) + mix(p[first] + np.uint64(scheme << 40)))


def _describe(n: int, t: float):
    """Batches of (doc_id, text) to (doc_id, size, f1, f2, made): the set's schemes with its non-empty parts in each (of small sets one more than they may differ in, so that none of their signatures can be spared)."""
    made_type = pa.list_(pa.struct([("scheme", pa.int32()), ("parts", pa.int64())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                out, made = np.zeros((3, batch.num_rows), np.int64), [[] for _ in range(batch.num_rows)]
                for row, s in sets(batch, n):
                    out[:, row] = len(s), *fingerprint(s)
                    made[row] = [{"scheme": g, "parts": differences(len(s), t) + 1 if g == SMALL else len(np.unique(_part(s, parts(g, t))))} for g in schemes(len(s), t)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out), pa.array(made, made_type)], ["doc_id", "size", "f1", "f2", "made"])

    return run


def _planes(x: np.ndarray, n: int = 5) -> bytes:
    """The n low bytes of each number, all lowest bytes first; long runs of equal bytes compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplanes(raw: bytes, n: int = 5) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(n, -1).T
    return out.view("<u8").ravel()


def _sign(n: int, t: float, buckets: int):
    """Batches of texts to packed signatures: one row for each bucket and pack (about PACK signatures).

    sig: 40 bits beside the bucket (35 of the hash, 5 of the scheme), sorted, as differences; fid: 40
    bits of each set's fingerprint. Too short a hash adds candidates only. A signature that more
    than HOT sets of one pack have is hot for certain: its members go to buckets by set instead
    (kind 1, with their bucket), and only a marker (fid 0) goes to its own bucket.
    """

    def pack(sig: np.ndarray, fid: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sig, kind="stable")
        sig, fid = sig[order], fid[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[first, len(sig)])
        hot = np.repeat(count > HOT, count)
        keep = ~hot
        keep[first] = True
        rows = [(0, sig[keep], np.where(hot, np.uint64(0), fid)[keep], sig[keep] >> np.uint64(40))]
        if hot.any():
            by = mix(fid[hot]) % np.uint64(buckets)
            order = np.argsort(by, kind="stable")
            rows.append((1, sig[hot][order], fid[hot][order], by[order]))
        for kind, sig, fid, bucket in rows:
            at = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            packed = [(_planes(np.diff(sig[i:j] & _LOW40, prepend=np.uint64(0))) if not kind else sig[i:j].tobytes(), _planes(fid[i:j])) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(packed), pa.int32()), pa.array(bucket[at[:-1]].astype(np.int32)), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary())],
                ["kind", "bucket", "sig", "fid"],
            )

    def run(batches):
        seen: set[tuple[int, int, int]] = set()
        sig, fid, held = [], [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for _, s in sets(batch, n):
                    own = (*fingerprint(s), len(s))
                    if own in seen:
                        continue
                    seen.add(own)
                    f = max((own[0] & _ALL) >> 24, 1)
                    for g in schemes(len(s), t):
                        x = signatures(s, g, t)
                        sig.append(((x % np.uint64(buckets)) << np.uint64(40)) | ((x >> np.uint64(29)) << np.uint64(5)) | np.uint64(g))
                        fid.append(np.full(len(x), f, np.uint64))
                        held += len(x)
                if held > PACK:
                    yield from pack(np.concatenate(sig), np.concatenate(fid))
                    seen, sig, fid, held = set(), [], [], 0
        if held:
            yield from pack(np.concatenate(sig), np.concatenate(fid))

    return run


def _match(batches):
    """Packed signatures, sorted by bucket, to pairs of cold groups (kind 0: two sets, scheme, shared signatures) and members of hot groups (kind 1: signature, set, scheme). One bucket is held at a time."""
    sig, fid, at = [], [], None
    pairs: list[tuple] = []

    def close():
        if sig:
            hot, found = _bucket(np.concatenate(sig), np.concatenate(fid))
            sig.clear(), fid.clear()
            if found is not None:
                pairs.append(found)
            if hot is not None:
                yield _rows(1, *hot, hot[0] & _SCHEME)
        if sum(len(x[0]) for x in pairs) > HELD_PAIRS:
            yield _counted(pairs)
            pairs.clear()

    for b in batches:
        for kind, bucket, s, f in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "sig", "fid"))):
            f = _unplanes(f)
            if kind:
                s = np.frombuffer(s, np.uint64)
                yield _rows(1, s, f, s & _SCHEME)
                continue
            if bucket != at:
                yield from close()
                at = bucket
            sig.append(np.cumsum(_unplanes(s), dtype=np.uint64) | np.uint64(bucket << 40)), fid.append(f)
    yield from close()
    if pairs:
        yield _counted(pairs)


def _bucket(sig: np.ndarray, fid: np.ndarray):
    """Of one bucket the hot signatures with their sets, and the pairs of sets in cold ones with their scheme; None where there is none."""
    order = np.argsort(sig, kind="stable")
    sig, fid = sig[order], fid[order]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    many = np.repeat((count := np.diff(np.r_[first, len(sig)])) > 1, count)
    sig, fid = sig[many], fid[many]
    if not len(sig):
        return None, None
    order = np.lexsort((fid, sig))
    sig, fid = sig[order], fid[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (fid[1:] != fid[:-1])]
    sig, fid = sig[keep], fid[keep]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    count = np.diff(np.r_[starts, len(sig)])
    marked = fid[starts] == 0
    hot = np.repeat(marked | (count > HOT), count) & (fid > 0)
    cold = ~marked & (count <= HOT) & (count > 1)
    starts, count = starts[cold], count[cold]
    found = []
    for size in np.unique(count):
        at = starts[count == size]
        for i, j in itertools.combinations(range(size), 2):
            found.append((fid[at + i], fid[at + j], sig[at] & _SCHEME))
    return (sig[hot], fid[hot]) if hot.any() else None, tuple(map(np.concatenate, zip(*found))) if found else None


def _counted(pairs: list[tuple]) -> pa.RecordBatch:
    a, b, g = map(np.concatenate, zip(*pairs))
    order = np.lexsort((g, b, a))
    a, b, g = a[order], b[order], g[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (g[1:] != g[:-1])])
    return _rows(0, a[first], b[first], g[first], np.diff(np.r_[first, len(a)]))


def _rows(kind: int, x: np.ndarray, y: np.ndarray, scheme: np.ndarray, shared: np.ndarray | None = None) -> pa.RecordBatch:
    shared = np.zeros(len(x)) if shared is None else shared
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(scheme.astype(np.int32)), pa.array(shared.astype(np.int32))], ["kind", "x", "y", "scheme", "shared"])


def _bytes_of_sets(n: int):
    """(doc_id, text) to (doc_id, f1, set); each document once in a task."""

    def run(batches):
        for whole in batches:
            seen: set[tuple] = set()
            for batch in slices(whole, "text"):
                ids = batch.column("doc_id").to_pylist()
                rows = [(row, s.tobytes(), f) for row, s in sets(batch, n) if (key := (ids[row], f := fingerprint(s))) not in seen and not seen.add(key)]
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[2][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "f1", "grams"])

    return run


def _verify(t: int):
    """Batches of (a, b, set of a, set of b): the pairs with 100 * intersection >= t * union."""

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                good = []
                for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    u = np.concatenate([x, y])
                    u.sort()
                    both = int((u[1:] == u[:-1]).sum())
                    good.append(100 * both >= t * (len(u) - both))
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _check(pairs: DataFrame, grams: DataFrame, t: int, name: str) -> DataFrame:
    """The pairs (a, b) of set representatives that are similar enough."""
    left = grams.select(F.col("rep").alias("b"), F.col("grams").alias("sb")).join(small(pairs), "b")
    both = left.join(grams.select(F.col("rep").alias("a"), F.col("grams").alias("sa")), "a")
    return stage(both.select("a", "b", "sa", "sb").mapInArrow(trimmed(_verify(t)), "a long, b long"), name)


def near_duplicates(docs: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id.

    Two documents are linked if their sets of n-word shingles (A-Z lower-cased, words between ASCII
    white space; with fewer than n words, the whole sequence as one) have a Jaccard similarity of
    percent / 100 or more. component_id is the smallest doc_id that links reach. Null or blank text:
    no shingles, own component. Rows with one doc_id are one document. A null doc_id links nothing
    and has a null component. Other columns are ignored. No link is lost, whatever a group's size
    (sets count as equal if their sizes and two 64-bit fingerprints are).
    """
    with scratch(docs.sparkSession, "jaccard-sets", "jaccard-classes"):
        return _near_duplicates(docs.select("doc_id", "text"), percent, n)


def _near_duplicates(docs: DataFrame, percent: int, n: int) -> DataFrame:
    spark, t = docs.sparkSession, percent / 100
    told = stage(docs.mapInArrow(trimmed(_describe(n, t)), "doc_id long, size long, f1 long, f2 long, made array<struct<scheme:int,parts:long>>"), "jaccard-sets")
    reps = told.where("size > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "size").agg(F.min("doc_id").alias("rep"), F.first("made").alias("made"))
    reps = stage(reps.withColumn("fid", F.greatest(F.shiftrightunsigned("f1", 24), F.lit(1))), "jaccard-reps")
    by = stage(reps.select("fid", "rep", "size", F.inline("made")), "jaccard-members")

    buckets = 4 * partitions(spark)
    packed = docs.where("doc_id IS NOT NULL").mapInArrow(trimmed(_sign(n, t, buckets)), "kind int, bucket int, sig binary, fid binary")
    dealt = packed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    found = stage(dealt.mapInArrow(trimmed(_match), "kind int, x long, y long, scheme int, shared int"), "jaccard-found")
    hot, often_hot = _hot_rows(found.where("kind = 1").selectExpr("x AS sig", "y AS fid", "scheme"), by, t)
    cold = found.where("kind = 0").groupBy("x", "y", "scheme").agg(F.sum("shared").alias("shared"))
    cold = _likely(cold, by, often_hot, t)
    # the leader of a hot group is its most ordinary member: with most hot signatures
    lead = hot.groupBy("sig").agg(F.max_by("rep", F.struct("h", -F.col("rep"))).alias("lead"), F.count("*").alias("members"))
    lead = stage(lead.where("members > 1").select("sig", "lead"), "jaccard-leads")
    star = hot.join(small(lead), "sig").where("rep <> lead").select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()
    star = stage(star, "jaccard-star")
    cold = cold.select("a", "b").union(_aside(docs, reps, by, n, t))
    pairs = stage(cold.union(star).distinct(), "jaccard-pairs")

    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(hot.select("rep")).distinct()
    need = small(stage(need.join(reps.select(F.col("rep").alias("doc_id"), "f1"), "doc_id"), "jaccard-need"))
    wanted = docs.join(need.select("doc_id"), "doc_id", "left_semi").mapInArrow(trimmed(_bytes_of_sets(n)), "doc_id long, f1 long, grams binary")
    grams = stage(wanted.join(need, ["doc_id", "f1"], "left_semi").selectExpr("doc_id AS rep", "grams"), "jaccard-grams")
    if grams.groupBy("rep").count().where("count > 1").limit(1).count():
        grams = stage(grams.groupBy("rep").agg(F.any_value("grams").alias("grams")), "jaccard-grams")

    # each set with its smallest partner first; then what still lies in different components
    first = stage(cold.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(star).distinct(), "jaccard-first")
    links = _check(first, grams, percent, "jaccard-links")
    label = stage(components(links, "jaccard"), "jaccard-labels")
    rest = _torn(pairs.join(first, ["a", "b"], "left_anti"), label)
    rest = stage(rest, "jaccard-rest")
    more = _across(_linkable(_members(hot, label), grams, percent), grams, percent)
    if rest.limit(1).count() or more.limit(1).count():
        links = links.union(_check(rest, grams, percent, "jaccard-links")).union(more)
        label = stage(components(links, "jaccard"), "jaccard-labels")
    classes = stage(reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "size", F.coalesce("label", "rep").alias("class")), "jaccard-classes")
    out = told.select("doc_id", "size", "f1", "f2").join(classes, ["f1", "f2", "size"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))


def _grams(n: int, bits=None):
    """(doc_id, text) to (doc_id, gram), of grams that a map lets through if there is one."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                for row, s in sets(batch, n):
                    s = s if bits is None else s[in_map(s, bits.value)]
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("doc_id")[row], len(s)), pa.array(s.view(np.int64))], ["doc_id", "gram"])

    return run


def _aside(docs: DataFrame, reps: DataFrame, by: DataFrame, n: int, t: float) -> DataFrame:
    """Pairs that signatures cannot promise: different sets with one fid, and sets with too few parts beside all that share an n-gram with them. Mostly there are none."""
    twins = reps.groupBy("fid").agg(F.count("*").alias("n")).where("n > 1").select("fid")
    mine = reps.join(twins, "fid", "left_semi").select("fid", "rep")
    pairs = mine.withColumnRenamed("rep", "a").join(mine.withColumnRenamed("rep", "b"), "fid").where("a < b").select("a", "b")
    few = by.where(F.col("parts") <= F.floor((F.col("size") + F.col("size") / t) * (1 - t) / (1 + t) + 1e-9))
    few = stage(few.select(F.col("rep").alias("doc_id")).distinct(), "jaccard-few")
    if few.limit(1).count():
        own = stage(docs.join(small(few), "doc_id", "left_semi").mapInArrow(_grams(n), "doc_id long, gram long").distinct(), "jaccard-few")
        bits = docs.sparkSession.sparkContext.broadcast(bitmap(own.withColumnRenamed("gram", "seed")))
        others = docs.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_grams(n, bits), "doc_id long, gram long")
        met = others.join(own.withColumnRenamed("doc_id", "few"), "gram").where("doc_id <> few")
        pairs = pairs.union(met.select(F.least("doc_id", "few").alias("a"), F.greatest("doc_id", "few").alias("b")).distinct())
    return stage(pairs, "jaccard-aside")


def _members(hot: DataFrame, label: DataFrame) -> DataFrame:
    """(sig, rep, size, label): the members of hot groups whose members lie in several components."""
    return _split(hot.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", "size", F.coalesce("label", "rep").alias("label")))


def _split(member: DataFrame) -> DataFrame:
    torn = member.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    return stage(member.join(small(stage(torn, "jaccard-torn")), "sig", "left_semi"), "jaccard-torn")


def _explode_sets(batches):
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            sets_ = [np.frombuffer(x, np.int64) for x in batch.column("grams").to_pylist()]
            times = np.array([len(x) for x in sets_])
            cols = [np.repeat(np.array(batch.column(c).to_pylist(), np.int64), times) for c in ("rep", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets_)), *map(pa.array, cols)], ["gram", "rep", "label"])


def _linkable(member: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The members that can still be similar to one of another component.

    A set shares with a set of another component at most those n-grams that other components have
    at all. If these are fewer than the least possible partner needs, the set drops out; that may
    leave others without partners, so it is done again while it helps.
    """
    left = member.select("rep").distinct().count()
    if not left:
        return member.withColumn("common", F.lit(0))
    while True:
        low = stage(member.groupBy("sig").agg(F.min("size").alias("low")), "jaccard-low")
        least = member.join(small(low), "sig").groupBy("rep").agg(F.first("size").alias("size"), F.first("label").alias("label"), F.min("low").alias("low"))
        least = stage(least, "jaccard-least")
        each = stage(grams.join(small(least.select("rep", "label")), "rep").select("rep", "label", "grams").mapInArrow(trimmed(_explode_sets), "gram long, rep long, label long"), "jaccard-grams-of")
        shared = stage(each.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram"), "jaccard-shared")
        common = each.join(shared, "gram", "left_semi").groupBy("rep").agg(F.count("*").alias("common"))
        low = F.greatest(F.col("low"), F.ceil(F.col("size") * percent / 100))
        live = stage(least.join(common, "rep").where((100 + percent) * F.col("common") >= percent * (F.col("size") + low)).select("rep", "common"), "jaccard-live")
        member = _split(member.select("sig", "rep", "size", "label").join(live, "rep").select("sig", "rep", "size", "label", "common"))
        now = member.select("rep").distinct().count()
        if now > 0.8 * left or not now:
            return member
        left = now


def _shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], many: tuple[int, int]) -> np.ndarray:
    """How many n-grams each set of one lot has in common with each of another; a lot: its n-grams' numbers, sorted, and their owners."""
    both = np.intersect1d(x[0], y[0])
    common = np.zeros(many, np.float32)
    for s in range(0, len(both), 4096):  # a slice of the n-grams at a time, to bound memory
        part, sides = both[s : s + 4096], []
        for (at, owner), n in zip((x, y), many):
            lo, hi = np.searchsorted(at, part[0]), np.searchsorted(at, part[-1], "right")
            place = np.searchsorted(part, at[lo:hi])
            here = part[place] == at[lo:hi]
            dense = np.zeros((n, len(part)), np.float32)
            dense[owner[lo:hi][here], place[here]] = 1
            sides.append(dense)
        common += sides[0] @ sides[1].T
    return common


def _compare(percent: int):
    """Two blocks of sets to links across their components: enough of them to join what is linked, no more. SUB sets of either are held against each other at a time."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted({(r, s): (s, r, i, g) for i, (r, s, g) in enumerate(zip(*(table[c].to_pylist() for c in ("rep", "side", "label"))))}.values())
        side, rep, label = np.array([r[0] for r in rows]), [r[1] for r in rows], [r[3] for r in rows]
        sets_ = [np.frombuffer(table["grams"][r[2]].as_py(), np.uint64) for r in rows]
        size = np.array([len(x) for x in sets_])
        lots = []
        for s in range(0, len(rows), SUB):
            at, owner = np.concatenate(sets_[s : s + SUB]), np.repeat(np.arange(len(sets_[s : s + SUB])), size[s : s + SUB])
            order = np.argsort(at, kind="stable")
            lots.append((at[order], owner[order]))
        root = {x: x for x in label}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in range(len(lots)):
            for j in range(i, len(lots)):
                p, q = np.arange(i * SUB, min((i + 1) * SUB, len(rows))), np.arange(j * SUB, min((j + 1) * SUB, len(rows)))
                wanted = (side[p][:, None] != side[q][None, :]) | (side[p][:, None] == 2)
                wanted &= p[:, None] < q[None, :]
                if not wanted.any():
                    continue
                common = _shared(lots[i], lots[j], (len(p), len(q)))
                near = wanted & (100 * common >= percent * (size[p][:, None] + size[q][None, :] - common))
                for a, b in zip(*np.nonzero(near)):
                    x, y = find(label[p[a]]), find(label[q[b]])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((rep[p[a]], rep[q[b]]))
        trim()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _across(member: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Links between different components of sets that are joined by hot groups, compared block by block.

    Sets that hot groups hold together form a cluster; a cluster is cut into blocks of BLOCK sets or
    so, and each two blocks are compared in one task. No pair becomes a row but links that join two
    components.
    """
    member = stage(member, "jaccard-live")
    lead = stage(member.groupBy("sig").agg(F.min("rep").alias("a")), "jaccard-leads")
    held = member.join(small(lead), "sig").select("a", F.col("rep").alias("b")).distinct()
    cluster = stage(components(held, "jaccard-clusters").withColumnRenamed("node", "rep").withColumnRenamed("label", "cluster"), "jaccard-clusters")
    sized = cluster.join(member.select("rep", "size").distinct(), "rep")
    n = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    put = cluster.join(n, "cluster").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # block i meets block j: once as the smaller number (side 0), once as the larger (side 1), with itself as side 2
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y"), F.when(F.col("i") == j, 2).when(F.col("i") < j, 0).otherwise(1).alias("side")))
    put = put.join(member.select("rep", "label").distinct(), "rep").select("rep", "label", "cluster", F.inline(meets))
    put = stage(put, "jaccard-blocks")
    whole = grams.join(put, "rep").select("cluster", "x", "y", "side", "rep", "label", "grams")
    return stage(whole.groupBy("cluster", "x", "y").applyInArrow(_compare(percent), "a long, b long"), "jaccard-links")


def _torn(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    pairs = pairs.join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left")
    return pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _hot_rows(rows: DataFrame, by: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """Of the sets that lack cold signatures, their k - cold + 1 rarest hot ones (sig, rep, size); and (fid, scheme, h): each set's hot ones."""
    rows = stage(rows.distinct(), "jaccard-hot")
    often_hot = stage(rows.groupBy("fid", "scheme").agg(F.count("*").alias("h")), "jaccard-hot")
    spare = F.col("parts") - F.floor((F.col("size") + F.col("size") / t) * (1 - t) / (1 + t) + 1e-9) - 1
    short = often_hot.join(by, ["fid", "scheme"]).withColumn("take", F.col("h") - spare).where("take > 0")
    short = stage(short.select("fid", "scheme", "rep", "size", "take", "h"), "jaccard-short")
    rows = stage(rows.join(short, ["fid", "scheme"]).select("sig", "scheme", "rep", "size", "take", "h"), "jaccard-hot")
    often = stage(rows.groupBy("sig").agg(F.count("*").alias("often")).where("often > 1"), "jaccard-often")
    ranked = rows.join(small(often), "sig", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    order = Window.partitionBy("rep", "scheme").orderBy("often", "sig")
    return stage(ranked.withColumn("k", F.row_number().over(order)).where("k <= take").groupBy("sig", "rep", "size").agg(F.max("h").alias("h")), "jaccard-hot"), often_hot


def _likely(cold: DataFrame, by: DataFrame, often_hot: DataFrame, t: float) -> DataFrame:
    """Of the pairs of sets with common signatures, those that can be similar by their sizes and the number of parts in which they agree."""
    hot_a, hot_b = often_hot.toDF("x", "scheme", "ha"), often_hot.toDF("y", "scheme", "hb")
    a, b = by.toDF("x", "ra", "na", "scheme", "pa"), by.toDF("y", "rb", "nb", "scheme", "pb")
    pairs = cold.join(a, ["x", "scheme"]).join(b, ["y", "scheme"]).where("ra <> rb").where(F.least("na", "nb") >= F.greatest("na", "nb") * (t - 1e-9))
    differ = F.floor((F.col("na") + F.col("nb")) * (1 - t) / (1 + t) + 1e-9)
    pairs = pairs.join(hot_a, ["x", "scheme"], "left").join(hot_b, ["y", "scheme"], "left")
    agree = F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    pairs = pairs.where((F.col("scheme") == SMALL) | (agree >= F.greatest("pa", "pb") - differ))
    return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
