"""Host-level rules against plain Python, with a host that fails, nulls, repeated rows and clashing names."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.llm import hosts

WORD = r"[^\x20\x09-\x0D]"


def measured(t):
    t = t or ""
    words = re.findall(WORD + "+", t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(windows)
    again = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(again)


def texts(rng, n):
    def one(kind):
        words = [rng.choice("ab cd ef gh ij kl mn été naïve 日本 #x *".split()) + rng.choice(["", "1", "2"]) for _ in range(rng.randint(0, 60))]
        t = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", " "]) for w in words)
        return [t, t + t, "\n".join([t] * 3), " \n " + t, "", None, t * 40][kind]

    return [one(rng.randrange(7)) for _ in range(n)]


def test_measures_by_brute_force(spark):
    rows = list(enumerate(texts(random.Random(1), 300))) + [(400, "w " * 100_000), (401, "a b c d e"), (402, "\x1c x \x85 y"), (None, "a b")]
    df = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    got = hosts.measure(df).collect()
    want = sorted((-1 if i is None else i, *measured(t)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def shapes(counts):
    """The prior by its definition: counts is a list of (n, f)."""
    k, n = len(counts), sum(x for x, _ in counts)
    mean = sum(f for _, f in counts) / n
    scatter = sum(x * (f / x - mean) ** 2 for x, f in counts)
    spread = n - sum(x * x for x, _ in counts) / n - (k - 1)
    own = (scatter - (k - 1) * mean * (1 - mean)) / (mean * (1 - mean) * spread) if 0 < mean < 1 and spread > 0 else 0
    weight = max(min(1 / own - 1, n) if own > 0 else n, 10)
    return mean * weight, (1 - mean) * weight


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    good = lambda i: " ".join(f"{rng.choice('abcdefgh')}{j}{i}x" for j in range(30))
    rows = [(i, good(i), f"h{i % 9}") for i in range(900)]
    rows += [(1000 + i, "buy now", f"h{i % 9}") for i in range(60)]  # some short ones everywhere
    rows += [(2000 + i, "too short" if i % 10 else good(i), "junk") for i in range(100)]  # a host of which nine in ten fail
    rows += [(3000, "tiny", "lone"), (3001, good(1), "other"), (4000, good(2), None), (4001, "x", None), (None, None, "h1"), (5, good(5), "h5"), (5, good(5), "h5")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_verdicts_of_hosts(spark, table):
    rows = table.collect()
    got = hosts.verdicts(table.withColumns({"host": F.lit("x"), "n": F.lit(1), "n_words": F.lit(0), "host_rules": F.lit("y"), "kept": F.lit(True)})).collect()
    assert len(got) == len(rows)
    counts = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        if r.source is not None:
            counts[r.source][0] += 1
            counts[r.source][1] += measured(r.text)[0] < 10
    a, b = shapes(list(map(tuple, counts.values())))
    failed = {h for h, (n, f) in counts.items() if (f + a) / (n + a + b) > 0.5}
    assert "junk" in failed and "lone" not in failed  # one bad document of a small host is no proof
    for r in got:
        assert r.host_rules == ("short" if r.host in failed else "")
        assert r.kept == (not r.base_failed and r.host not in failed)
    assert all(r.kept for r in got if r.doc_id in (3001, 4000, 5)) and not any(r.kept for r in got if r.host == "junk")


def test_shuffled_join_gives_the_same(spark, table, monkeypatch):
    want = sorted(map(str, hosts.verdicts(table).collect()))
    monkeypatch.setattr(hosts, "HOT_SHARE", 2), monkeypatch.setattr(hosts, "small", lambda df: df)
    assert sorted(map(str, hosts.verdicts(table).collect())) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert hosts.verdicts(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 3, empty.schema)
    assert [(r.n_words, r.base_failed, r.kept) for r in hosts.verdicts(nulls).collect()] == [(0, True, False)] * 3
