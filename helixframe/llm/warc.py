"""WARC archives with a two-level capture index.

Pages are sorted by their reversed-host key and written as one gzip member per record. Beside each
archive lies a block-compressed index of its captures; a sparse directory has one row per block. A
lookup narrows the directory by key, reads one block, searches it by bisection and reads the record's
range only.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, stage

#: Payloads of fewer bytes are always written in full.
REVISIT_FROM = 100
#: An index block closes after so many captures, or so many bytes of records.
BLOCK_LINES, BLOCK_BYTES = 2000, 8 << 20
#: Date of a capture whose table has none.
DATE = "1970-01-01T00:00:00Z"

DIRECTORY = "first_key string, last_key string, index_file string, index_at long, index_bytes long, warc_file string, warc_at long, warc_bytes long, captures long"


def url_key(url: Column) -> Column:
    """The host's labels in reverse order, then path and query: com,example,www)/a?b. Null: empty."""
    part = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]+)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, part, 1)), r"\.")), ",")
    rest = F.regexp_extract(url, part, 2)
    key = F.concat(host, F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20]", "+"), F.lit(""))


def _header(lines: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {re.sub('[\x00-\x1f]', '+', str(v))}\r\n" for k, v in lines) + "\r\n").encode()


def _record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    name = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", url or ""), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", len(payload))]
    if first is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        name += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}>")]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    name += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return gzip.compress(_header(name) + block + b"\r\n\r\n", 6, mtime=0)


def _parse(member: bytes) -> dict:
    """One record: its header fields, kind and payload (None for a revisit)."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    page = lambda v: int(v) if (v := v[len("<urn:page:") : -1]) else None
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload": payload,
        "payload_digest": digest, "payload_bytes": len(payload) if payload is not None else int(fields["WARC-Payload-Length"]), "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
    }


def _write(root: str):
    """Sorted batches of one partition to an archive and its index; yields directory rows.

    File names are new for each attempt, and only the attempt that commits has its rows in the
    directory; so a task that runs twice leaves at worst a file that nothing points to.
    """

    def run(batches):
        store, at_root = fs.FileSystem.from_uri(root)
        store.create_dir(at_root, recursive=True)
        name = uuid.uuid4().hex
        warc, index, done, lines = None, None, [], []
        where = index_where = begun = 0

        def close():
            nonlocal lines, index_where, begun
            member = gzip.compress("".join(f"{k}\t{p}\t{o}\t{n}\n" for k, p, o, n in lines).encode(), 6, mtime=0)
            index.write(member)
            done.append((lines[0][0], lines[-1][0], f"{name}.idx.gz", index_where, len(member), f"{name}.warc.gz", begun, where - begun, len(lines)))
            index_where, begun, lines = index_where + len(member), where, []

        for batch in batches:
            for key, page_id, url, html, digest, first in zip(*(batch.column(c) for c in ("key", "page_id", "url", "html", "digest", "first"))):
                if warc is None:
                    warc, index = store.open_output_stream(f"{at_root}/{name}.warc.gz", compression=None), store.open_output_stream(f"{at_root}/{name}.idx.gz", compression=None)
                member = _record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), first.as_py())
                warc.write(member)
                lines.append((key.as_py(), "" if page_id.as_py() is None else page_id.as_py(), where, len(member)))
                where += len(member)
                if len(lines) >= BLOCK_LINES or where - begun >= BLOCK_BYTES:
                    close()
        if warc is not None:
            if lines:
                close()
            warc.close(), index.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["first_key", "last_key", "index_file", "index_at", "index_bytes", "warc_file", "warc_at", "warc_bytes", "captures"])

    return run


def write_archive(pages: DataFrame, root: str | None = None) -> tuple[str, DataFrame]:
    """Write pages(page_id, url, html) as WARC archives under root (a folder that all machines share).

    Returns root and the sparse directory of index blocks. Payload: the html in UTF-8 (null: empty).
    Of pages with equal payloads of REVISIT_FROM bytes or more, that with the smallest page_id is
    written in full, the others as revisits of it; pages that repeat its page_id are also written
    in full. Null page_id or url are allowed; an empty table gives an empty directory.
    """
    spark = pages.sparkSession
    root = root or new_path(spark, "warc")
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html", url_key(F.col("url")).alias("key"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("bytes"))
    first = stage(keyed.where(F.col("bytes") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc-first")
    keyed = keyed.join(first, "digest", "left").withColumn("first", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))
    ordered = keyed.repartitionByRange(partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id")
    return root, stage(ordered.select("key", "page_id", "url", "html", "digest", "first").mapInArrow(_write(root), DIRECTORY), "warc-directory")


_NAMES = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
_SCHEMA = pa.schema(zip(_NAMES, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]))


def _captures(lines: list[list[str]], keys: list[str]) -> Iterator[tuple[int, int]]:
    """The ranges of the captures of these keys (sorted), each found by bisection of a block's lines."""
    for key in keys:
        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while at < len(lines) and lines[at][0] == key:
            yield int(lines[at][2]), int(lines[at][3])
            at += 1


def _read(store, at_root: str, block: dict, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The records of some keys of one index block; ranges that touch are read at once."""
    with store.open_input_file(f"{at_root}/{block['index_file']}") as f:
        text = gzip.decompress(f.read_at(block["index_bytes"], block["index_at"])).decode()
    runs: list[list[tuple[int, int]]] = []
    for offset, n in _captures([x.split("\t") for x in text.split("\n")[:-1]], keys):
        if runs and runs[-1][-1][0] + runs[-1][-1][1] == offset and offset + n - runs[-1][0][0] <= BLOCK_BYTES:
            runs[-1].append((offset, n))
        else:
            runs.append([(offset, n)])
    with store.open_input_file(f"{at_root}/{block['warc_file']}") as f:
        for run in runs:
            begin = run[0][0]
            whole = f.read_at(run[-1][0] + run[-1][1] - begin, begin)
            out, size = [], 0
            for offset, n in run:
                out.append(_parse(whole[offset - begin : offset - begin + n]))
                size += out[-1]["payload_bytes"]
                if size > BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)


def _blocks(root: str):
    """Rows of (block, key), sorted by block and key, to the records; keys of one block come in bounded lots."""
    own = ["index_file", "index_at", "index_bytes", "warc_file"]

    def run(batches):
        store, at_root = fs.FileSystem.from_uri(root)
        block, keys = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*own, "key"))):
                if row[:-1] != block or len(keys) >= BLOCK_LINES:
                    if keys:
                        yield from _read(store, at_root, dict(zip(own, block)), keys)
                    block, keys = row[:-1], []
                keys.append(row[-1])
        if keys:
            yield from _read(store, at_root, dict(zip(own, block)), keys)

    return run


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _archives(sent):
    """Keys to (key, index_file) of the archives whose range holds them."""

    def run(batches):
        ranges = sent.value
        lows = [r[0] for r in ranges]
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                at = bisect.bisect_right(lows, key) - 1
                while at >= 0 and ranges[at][1] >= key:
                    out.append((key, ranges[at][2]))
                    at -= 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], ["key", "index_file"])

    return run


def lookup(spark: SparkSession, root: str, directory: DataFrame, urls: list[str] | DataFrame) -> DataFrame:
    """The records of some URLs (a list, or a table with a column url), each once.

    The URLs' keys meet the archives whose range of keys holds them, then the blocks of the sparse
    directory likewise; blocks are read one by one, searched by bisection, and only the ranges of the
    keys' captures are read from the archives. Null URLs have the empty key. A key that fills many
    blocks is read block by block. The list of archives (one row for each task that wrote) is sent to
    the executors and searched by bisection; ranges of archives share no more than their edges.
    """
    asked = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")
    keys = asked.select(url_key(F.col("url")).alias("key")).distinct()
    archives = directory.groupBy("index_file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    sent = spark.sparkContext.broadcast(sorted((r.low, r.high, r.index_file) for r in archives))
    mine = keys.mapInArrow(_archives(sent), "key string, index_file string")
    met = mine.join(directory, "index_file").where(F.col("key").between(F.col("first_key"), F.col("last_key")))
    dealt = met.repartition(partitions(spark), "index_file", "index_at").sortWithinPartitions("index_file", "index_at", "key")
    return dealt.select("index_file", "index_at", "index_bytes", "warc_file", "key").mapInArrow(_blocks(root), RECORDS)


def read_archive(root: str, directory: DataFrame) -> DataFrame:
    """Every record of the archives: all keys of each block. An empty directory gives no rows; a null page_id comes back as null, a null url as empty."""
    spark = directory.sparkSession
    store = lambda: fs.FileSystem.from_uri(root)

    def keys(batches):
        files, at_root = store()
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{at_root}/{row['index_file']}") as f:
                    lines = gzip.decompress(f.read_at(row["index_bytes"], row["index_at"])).decode().split("\n")[:-1]
                yield from _read(files, at_root, row, list(dict.fromkeys(x.split("\t")[0] for x in lines)))

    return directory.repartition(partitions(spark)).mapInArrow(keys, RECORDS)
