"""Host-level quality rules: rates of failing documents by host, shrunk with an empirical beta prior.

Each document is measured once; what it fails is counted by host; a host fails a rule if its shrunk
rate of failing documents is over the rule's limit; the verdict goes back to the host's documents.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

#: White space that parts words, and characters that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "[#*$%&|<>]"
#: Words of a window whose second occurrence in a text makes its words repeated ones.
WINDOW = 5
#: Rules of a document that decide alone.
BASE = {"short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words"}
#: Rules counted by host: what a failing document is, and the shrunk rate of such documents over which a host fails.
RULES: dict[str, tuple[str, float]] = {
    "short": (BASE["short"], 0.5),
    "repeats": (BASE["repeats"], 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "lines": ("10 * n_dup_lines > 3 * n_lines", 0.5),
    "word_length": ("n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)", 0.5),
}
#: Hosts with more than this share of all documents are at most 10,000 and always broadcast; no other key of the shuffled join is larger.
HOT_SHARE = 10_000
#: Documents that a prior weighs at least, so that a handful of bad documents is no proof against a host.
LEAST_WEIGHT = 10.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words in windows (an array of hashes by place) that occur twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twin = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    places = F.array_sort(F.transform(_let(placed, twin), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["to"])).alias("n"), (i + WINDOW).alias("to")), lambda acc: acc["n"])


def _repeated(hashes: Column) -> Column:
    """Words of a text (an array of their hashes) that lie in repeated windows."""
    at = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)])
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), at)
    found = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(0))
    return F.when(F.size(hashes) > WINDOW, found).otherwise(0)


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of each row.

    Words are runs of anything but SPACE; word_chars: their code points; n_symbols: characters of
    SYMBOLS; n_lines: lines between newlines that hold a word, n_dup_lines: those of them equal to an
    earlier one; n_repeat_words: words in windows of WINDOW words found twice or more in the text, by
    64-bit hashes. Null text counts as empty: all are 0. Rows that repeat stay as often as they are.
    """
    text = F.coalesce("text", F.lit(""))
    blank = f"[{SPACE}]+"
    trimmed = F.btrim(text, F.lit(SPACE))
    hashes = F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, blank), lambda w: F.xxhash64(w)))
    words = _let(hashes, lambda h: F.struct(F.size(h).alias("n"), _repeated(h).alias("again")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    told = docs.select("doc_id", F.col(host).alias("host"), words.alias("_w"), lines.alias("_l"), (F.length(text) - F.length(F.regexp_replace(text, f"[^{SPACE}]+", ""))).alias("word_chars"), (F.size(F.split(text, SYMBOLS)) - 1).alias("n_symbols"))
    n = lambda c, name: F.col(c).cast("long").alias(name)
    return told.select("doc_id", "host", n("_w.n", "n_words"), n("word_chars", "word_chars"), n("n_symbols", "n_symbols"), n("_l.n", "n_lines"), n("_l.again", "n_dup_lines"), n("_w.again", "n_repeat_words"))


def prior(n_hosts: int, n_docs: int, squares: float, failed: int, scatter: float) -> tuple[float, float]:
    """Shape (a, b) of the beta prior of one rule's rate, by moments over hosts.

    squares: the sum of n * n, scatter: the sum of f * f / n over hosts of n documents of which f
    fail. The scatter beyond that of equal rates gives the hosts' own share of the variance (analysis
    of variance); where it is none, the prior weighs as much as all documents. a + b is at least LEAST_WEIGHT.
    """
    mean = failed / n_docs if n_docs else 0.0
    spread = n_docs - squares / n_docs - (n_hosts - 1) if n_docs else 0.0
    inside = mean * (1 - mean)
    own = (scatter - failed * mean - (n_hosts - 1) * inside) / (inside * spread) if inside > 0 and spread > 0 else 0.0
    weight = min(1 / own - 1, float(n_docs)) if own > 0 else float(n_docs)
    weight = max(weight, LEAST_WEIGHT)
    return mean * weight, (1 - mean) * weight


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, <rule>_failed, <rule>_rate, host_rules) of each host but null; rate: (failed + a) / (n + a + b) by the rule's prior; host_rules: the rules it fails, comma-joined.

    Counts are partial sums, so a host of any size is a few numbers. The driver sees one row of sums.
    """
    fails = [F.count_if(F.expr(rule)).alias(f"{name}_failed") for name, (rule, _) in RULES.items()]
    counted = stage(measured.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *fails), "host-counts")
    moments = [x for name in RULES for x in (F.sum(f"{name}_failed").alias(f"{name}_f"), F.sum(F.col(f"{name}_failed") * F.col(f"{name}_failed") / F.col("n")).alias(f"{name}_s"))]
    m = counted.agg(F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), *moments).first()
    shapes = {name: prior(m["hosts"], m["docs"] or 0, m["squares"] or 0.0, m[f"{name}_f"] or 0, m[f"{name}_s"] or 0.0) for name in RULES}
    rates = counted.select("*", *[((F.col(f"{name}_failed") + a) / (F.col("n") + a + b)).alias(f"{name}_rate") for name, (a, b) in shapes.items()])
    return rates.withColumn("host_rules", F.concat_ws(",", *[F.when(F.col(f"{name}_rate") > limit, F.lit(name)) for name, (_, limit) in RULES.items()]))


def verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs(doc_id, text, host) measured, with base_failed, host_rules and kept.

    base_failed: the document fails a rule of BASE. host_rules: what its host fails (empty: nothing).
    kept: neither. A null host has no verdict and does not count for the prior. Other columns are
    ignored; an empty table gives no rows.
    """
    measured = stage(measure(docs, host), "host-measured")
    rates = stage(host_rates(measured).where("host_rules <> ''").select("host", "n", "host_rules"), "host-verdicts")
    total = measured.count()
    hot = F.col("n") * HOT_SHARE >= total
    own = measured.join(F.broadcast(rates.where(hot).select("host", F.col("host_rules").alias("_hot"))), "host", "left")
    own = own.join(small(rates.where(~hot).select("host", "host_rules")), "host", "left")
    base = F.lit(False)
    for rule in BASE.values():
        base |= F.expr(rule)
    own = own.withColumn("host_rules", F.coalesce("_hot", "host_rules", F.lit(""))).withColumn("base_failed", base)
    return own.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_rules", (~F.col("base_failed") & (F.col("host_rules") == "")).alias("kept"))
