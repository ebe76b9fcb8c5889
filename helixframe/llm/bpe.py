"""Byte-level BPE over a corpus: each distinct pre-token is encoded once, wherever it occurs.

Texts are cut into pre-tokens; a chunk (a bounded run of texts) keeps its own word list, and each
text becomes the list of its pre-tokens' places there. The word lists are dealt out by a hash of the
word over the whole corpus, each distinct word of a deal is encoded once, and its ids go back to the
chunks, where the texts are put together again by position.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import partitions, slices, stage, trim, trimmed

#: Pre-tokens after which a chunk is closed.
CHUNK = 900_000
#: Bytes of a text that are cut into pre-tokens at once, so that memory stays bounded.
PIECE = 1 << 20
#: Words of a deal whose ids a task remembers; beyond it a word may be encoded again, so that memory stays bounded.
REMEMBER = 100_000


def ranks(spark, path: str) -> dict[bytes, int]:
    """A rank file (base64 token and rank in each line), read by Spark: a bounded vocabulary."""
    rows = spark.read.text(path if "://" in path else f"file://{path}").where("value <> ''").collect()
    return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in rows)}


@functools.lru_cache(2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def pre_tokens(text: str, pattern: str) -> list[str]:
    """The matches of the pattern, in order. Long texts go piece by piece, cut between a letter and a space."""
    find = _pattern(pattern).findall
    if len(text) <= PIECE:
        return find(text)
    out, at = [], 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < len(text) and not (text[to] == " " and text[to - 1].isalpha()):
            to += 1
        out += find(text[at:to])
        at = to
    return out


def _squeeze(x: np.ndarray) -> bytes:
    """Non-negative 32-bit integers: their bytes plane by plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _spread(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _squeeze_words(ws: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in ws]
    whole = b"".join(raw)
    return _squeeze(np.fromiter(map(len, raw), np.uint32, len(raw))), len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def _spread_words(lengths: bytes, words: bytes) -> list[str]:
    whole = pa.decompress(words[8:], int.from_bytes(words[:8], "little"), "zstd", asbytes=True)
    ends = np.cumsum(_spread(lengths)).tolist()
    return [whole[s:e].decode() for s, e in zip([0, *ends[:-1]], ends)]


def _pack_ids(ids: list[int | None]) -> bytes:
    """Ids as 64-bit integers, behind a byte each that tells whether it is there."""
    return bytes(x is not None for x in ids) + np.array([x or 0 for x in ids], "<i8").tobytes()


def _unpack_ids(raw: bytes) -> list[int | None]:
    n = len(raw) // 9
    return [x if there else None for there, x in zip(raw[:n], np.frombuffer(raw[n:], "<i8").tolist())]


_CODED = "check long, chunk long, deal int, doc_ids binary, lengths binary, places binary, words binary"
_NAMES = ["check", "chunk", "deal", "doc_ids", "lengths", "places", "words"]


def _chunks(pattern: str, deals: int, kind: int):
    """Batches of (doc_id, text) to rows of one kind: 0, the places of some texts' pre-tokens in their chunk's word list; 1, the words of a chunk in one deal.

    check tells the word list, so that rows of both kinds that do not belong together are found out.
    """
    schema = pa.schema(zip(_NAMES, [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]))

    def close(chunk: int, held: list, places: dict[str, int]) -> Iterator[pa.RecordBatch]:
        # frequent words get small numbers, so that numbers compress well
        often = np.bincount(np.concatenate([x for _, _, x in held]), minlength=len(places))
        rank = np.empty(len(places), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(places))
        check = crc32("\x00".join(places).encode())
        if not kind:
            for ids, lengths, x in held:
                yield pa.RecordBatch.from_arrays([pa.array([check]), pa.array([chunk]), pa.nulls(1, pa.int32()), pa.array([_pack_ids(ids)]), pa.array([_squeeze(lengths)]), pa.array([_squeeze(rank[x])]), pa.nulls(1, pa.binary())], schema=schema)
            return
        words = np.array(list(places), dtype=object)
        by = np.fromiter((crc32(w.encode()) % deals for w in words), np.int64, len(words))
        for order in np.split(order := np.lexsort((rank, by)), np.flatnonzero(np.diff(by[order])) + 1):
            if len(order):
                lengths, whole = _squeeze_words(words[order].tolist())
                yield pa.RecordBatch.from_arrays([pa.array([check]), pa.array([chunk]), pa.array([by[order[0]]], pa.int32()), pa.nulls(1, pa.binary()), pa.array([lengths]), pa.array([_squeeze(np.diff(rank[order], prepend=0))]), pa.array([whole])], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        chunk, count = TaskContext.get().partitionId() << 24, 0
        held: list = []
        places: dict[str, int] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                coded = []
                for text in batch.column("text").to_pylist():
                    found = pre_tokens(text or "", pattern)
                    coded.append(np.fromiter((places.setdefault(w, len(places)) for w in found), np.int32, len(found)))
                lengths = np.array([len(x) for x in coded])
                held.append((batch.column("doc_id").to_pylist(), lengths, np.concatenate(coded)))
                count += int(lengths.sum())
                if count >= CHUNK:
                    yield from close(chunk, held, places)
                    chunk, count, held, places = chunk + 1, 0, [], {}
        if held:
            yield from close(chunk, held, places)

    return run


def _encode(vocabulary):
    """Rows of one deal's words to their ids: each distinct word of the task is encoded once (of a deal of more than REMEMBER, again at times)."""

    def run(batches):
        import tiktoken

        enc = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary.value, special_tokens={})
        known: dict[str, list[int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for w in _spread_words(row["lengths"], row["words"]):
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= REMEMBER:
                            known.clear()
                        ids = known[w] = enc.encode_ordinary(w)
                    out.append(ids)
                lengths, flat = np.fromiter(map(len, out), np.int64, len(out)), np.array([i for ids in out for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["check"]]), pa.array([row["chunk"]]), pa.array([row["places"]]), pa.array([_squeeze(lengths)]), pa.array([_squeeze(flat)])], ["check", "chunk", "places", "lengths", "ids"])

    return run


def _assemble(table=None):
    """The texts of one chunk: ids by position, and their bytes if there is a (broadcast) table of tokens."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        out = _texts(docs, words)
        trim()
        return out if table is None else out.append_column("decoded", pa.array((_bytes_of(x.as_py(), table.value) for x in out["ids"]), pa.binary()))

    return run


def _bytes_of(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, np.int32).tolist()))


def _texts(docs: pa.Table, words: pa.Table) -> pa.Table:
    if len({*docs["check"].to_pylist(), *words["check"].to_pylist()}) > 1:
        raise ValueError("the table gave its rows in another order when it was read again; stage it first")
    column = lambda t, c: (x.as_py() for x in t[c])
    place = np.concatenate([np.cumsum(_spread(x)).astype(np.int32) for x in column(words, "places")] or [np.zeros(0, np.int32)])
    length = np.concatenate([_spread(x).astype(np.int32) for x in column(words, "lengths")] or [np.zeros(0, np.int32)])
    flat = np.concatenate([_spread(x).astype(np.int32) for x in column(words, "ids")] or [np.zeros(0, np.int32)])
    size, start = np.zeros(len(place), np.int32), np.zeros(len(place), np.int64)
    size[place] = length
    start[place] = np.cumsum(length, dtype=np.int64) - length
    doc_ids, out = [], []
    for ids, lengths, places in zip(*(column(docs, c) for c in ("doc_ids", "lengths", "places"))):
        places = _spread(places)
        doc_ids += _unpack_ids(ids)
        for p in np.split(places, np.cumsum(_spread(lengths))[:-1]):
            n = size[p]
            ends = np.cumsum(n, dtype=np.int64)
            at = np.arange(ends[-1] if len(p) else 0) + np.repeat(start[p] - (ends - n), n)
            out.append(flat[at].tobytes())
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out, pa.binary())})


def encode(docs: DataFrame, vocabulary: dict[bytes, int], pattern: str, decoded: bool = False) -> DataFrame:
    """docs(doc_id, text) to (doc_id, ids): ids as little-endian 32-bit integers in one binary.

    Each match of the pattern is encoded by itself by the ranks, without special tokens. Null text
    counts as empty and gives no ids; null and repeated doc_ids stay as they are; other columns are
    ignored. One row out for each row in. The table is read twice, once for the texts' places and
    once for the words, and has to give its rows in one order; one that comes out of a shuffle is
    written first. With decoded, the ids are decoded where they are put together (as by decode()).
    """
    spark = docs.sparkSession
    deals = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stage(docs, "bpe")  # rows out of a shuffle may come in another order the next time
    sent = spark.sparkContext.broadcast(vocabulary)
    texts, words = (docs.mapInArrow(trimmed(_chunks(pattern, deals, kind)), _CODED) for kind in (0, 1))
    words = words.repartition(deals, "deal").mapInArrow(trimmed(_encode(sent)), "check long, chunk long, places binary, lengths binary, ids binary")
    table = spark.sparkContext.broadcast(_table(vocabulary)) if decoded else None
    return texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_assemble(table), "doc_id long, ids binary" + ", decoded binary" * decoded)


def _table(vocabulary: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        table[i] = token
    return table


def decode(coded: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """coded(doc_id, ids, ...) with a column decoded: the bytes of the ids, looked up in the token-byte table (bounded by the vocabulary). Null ids give null."""
    sent = coded.sparkSession.sparkContext.broadcast(_table(vocabulary))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                out = [None if x is None else _bytes_of(x, sent.value) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return coded.mapInArrow(trimmed(run), StructType([*coded.schema.fields, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, vocabulary: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs.

    Null and empty text have no tokens and the digests of no bytes; null and repeated doc_ids stay.
    Other columns are ignored, an empty table gives no rows.
    """
    both = encode(docs, vocabulary, pattern, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
