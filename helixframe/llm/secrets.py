"""Secret scan: strong patterns, and weak parts that only count where complementary parts lie together."""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices

#: Fixed patterns and least lengths of the strong kinds, and the words without which `assign` cannot match.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 12

#: Weak parts: an identifier by its name, a value that looks random, an address of a service.
WEAK_ID = re.compile(r"""(?i:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{4,})""", re.ASCII)
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What a value that looks random holds, wherever in it.
MIXED = (re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]"))
ENDPOINT = re.compile(r"(?:https?|s3|jdbc|postgres|mysql|redis|amqp|mongodb)://[^\s\"'<>]+")
#: Length from which a short assigned value counts with an endpoint and no identifier.
LEAST_ALONE = 8
#: Code points around an access identifier or a secret in which its complementary parts are looked for.
REACH = 300

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_value", "endpoint")
SPANS = "array<struct<kind:string,start:int,end:int>>"


def _within(parts: list[tuple], starts: list[int], ends: list[int], low: int, high: int) -> list[tuple]:
    """The parts that overlap [low, high): the probe side of the interval join. Parts are sorted by start; ends is the running maximum of their ends."""
    return [x for x in parts[bisect.bisect_right(ends, low) : bisect.bisect_left(starts, high)] if x[2] > low]


def _by_kind(parts: list[tuple]) -> list[tuple]:
    """Parts apart by kind: spans of one kind do not overlap, so that a probe reads no more than it finds."""
    kinds: dict[str, list[tuple]] = {}
    for x in sorted(parts, key=lambda x: x[1]):
        kinds.setdefault(x[0], []).append(x)
    return [(x, *_bounds(x)) for x in kinds.values()]


def _among(kinds: list[tuple], low: int, high: int) -> list[tuple]:
    return [x for k in kinds for x in _within(*k, low, high)]


def _bounds(parts: list[tuple]) -> tuple[list[int], list[int]]:
    return [x[1] for x in parts], list(itertools.accumulate((x[2] for x in parts), max))


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as listed; code points, end exclusive."""
    low = text.lower()
    base, weak, short = [], [], set()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                base.append(("assign", *m.span()))
            elif len(m[2]) >= 6:
                weak.append(("weak_value", *m.span()))
                if len(m[2]) < LEAST_ALONE:
                    short.add(weak[-1])
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    ids = [x for x in base if x[0] == "access"]
    if "=" in text or ":" in text:
        ids += [("weak_id", *m.span()) for m in WEAK_ID.finditer(text)]
    out = set(base)
    places = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    if ids or places:
        ids.sort(key=lambda x: x[1])
        taken = _by_kind(base)
        found = [("weak_secret", *m.span()) for m in WEAK_SECRET.finditer(text) if all(x.search(m[0]) for x in MIXED) and not _among(taken, *m.span())]
        keys = [x for x in base if x[0] != "access"] + weak + found
        key_at, place_at = _by_kind(keys), _by_kind(places)
        for i in ids:
            scope = (i[1] - REACH, i[2] + REACH)
            with_it = [x for x in _among(key_at, *scope) if x[2] <= i[1] or i[2] <= x[1]]
            if with_it:  # an identifier and a secret: both count, and endpoints in the same scope
                out |= {i, *with_it, *_among(place_at, *scope)}
        for x in keys if places else ():
            if x not in short and not _among(place_at, x[1], x[2]):  # a secret that is not part of an address, and addresses: all count
                near = _among(place_at, x[1] - REACH, x[2] + REACH)
                out |= {x, *near} if near else set()
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], order[x[0]], x[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, spans.

    Strong kinds (assign, access, hex) are always reported. The multipart rule adds weak ones: an
    access identifier (strong, or weak by its name) and a secret (strong, a short assigned value or a
    random-looking word) within REACH of each other are both reported, and so are endpoints there. A
    secret (a short assigned value from LEAST_ALONE on) that is not part of an endpoint, and endpoints
    within REACH, are reported without an identifier too.
    Null text counts as empty; empty gives no spans; null and repeated doc_ids stay; other columns
    are ignored. Whole texts are scanned.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [[dict(zip(("kind", "start", "end"), x)) for x in spans(t or "")] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, schema.field(1).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """docs with each found span of its text replaced by its kind; overlapping spans become one. n_chars, if there, follows.

    Null text stays null; every row and column stays, repeated ones too; an empty table gives no rows.
    """
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        for kind, s, e in spans(text) if text else []:
            if s >= done:
                out += [text[done:s], mark.format(kind)]
            done = max(done, e)
        return text if not out else "".join(out) + text[done:]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                cols = list(batch.columns)
                cols[at] = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    out = docs.mapInArrow(run, StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(found: DataFrame) -> DataFrame:
    """The digest columns of find_secrets' rows: counts, the strong spans' SHA-256 and all spans as text."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    strong = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(strong), 256).alias("base_sha256"), text("spans").alias("spans"))


