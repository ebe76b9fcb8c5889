"""Language ID by word-first backoff.

A known word is scored by its log frequency in each language. An unknown word falls back to its
character n-grams, the longest first: the first length of which any n-gram is known scores it. Words
of which not even a letter is known are no evidence, and lower the score.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices, trimmed

#: The model is fitted on about so many labelled documents at most (chosen by a hash of doc_id).
SAMPLE = 4_000
#: Lengths of n-grams, in the order of backoff; a word is read with its edges marked (single letters without).
LENGTHS = (5, 4, 3, 2, 1)
#: What an unseen entry counts.
UNSEEN = 0.1
#: Words of which a task remembers the scores.
REMEMBER = 100_000
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    langs: list[str]
    prior: np.ndarray
    #: For each kind of entry (0: words, n: n-grams) the entries' rows in a matrix of log frequencies by language.
    tables: dict[int, tuple[dict[str, int], np.ndarray]]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if there is no letter (a run may hold other numerals such as superscripts)."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(w.isalpha() for w in found) or any(c.isalpha() for w in found for c in w) else []


def held_out(doc_id: Column) -> Column:
    """Documents of the fold that nothing is learned from; null ids are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on docs(doc_id, text, lang) outside the held-out fold with text and lang.

    Word counts come from a sample of bounded size, n-gram counts from the counted words. All words
    and n-grams of the sample are kept, so the sample bounds the tables.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(per_lang.values())
    if not total:
        return Model([], np.zeros(0), {})
    part = min(1.0, sample / total)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)

    def count(batches):
        from collections import Counter

        for whole in batches:
            for batch in slices(whole, "text"):
                counts: dict[str, Counter] = {}
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                    counts.setdefault(lang, Counter()).update(words_of(text))
                rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["lang", "entry", "n"])

    words = chosen.select("text", "lang").mapInArrow(count, "lang string, entry string, n long")
    words = words.groupBy("lang", "entry").agg(F.sum("n").alias("n")).select("lang", F.lit(0).alias("kind"), "entry", "n").cache()
    marked = F.concat(F.lit("<"), "entry", F.lit(">"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, F.lit(n)))
    letters = lambda n: grams(n) if n > 1 else F.filter(grams(1), lambda x: ~x.isin("<", ">"))
    pieces = [words.where(F.length("entry") >= n - 2).select("lang", F.lit(n).alias("kind"), F.explode(letters(n)).alias("entry"), "n") for n in LENGTHS]
    counted = functools.reduce(DataFrame.union, pieces).groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n")).union(words).select("lang", "kind", "entry", "n")
    rows = counted.toArrow()
    words.unpersist()
    langs = sorted(filter(None, pc.unique(rows["lang"]).to_pylist())) or sorted(per_lang)
    tables = {}
    for kind in pc.unique(rows["kind"]).to_pylist():
        own = rows.filter(pc.equal(rows["kind"], kind))
        names = pc.unique(own["entry"])
        matrix = np.full((len(names), len(langs)), UNSEEN, np.float32)
        matrix[pc.index_in(own["entry"], names).to_numpy(), pc.index_in(own["lang"], pa.array(langs)).to_numpy()] = own["n"].to_numpy()
        tables[kind] = dict(zip(names.to_pylist(), range(len(names)))), np.log(matrix) - np.log(matrix.sum(axis=0, dtype=np.float64)).astype(np.float32)
    prior = np.array([per_lang.get(x, 0) for x in langs], float)
    return Model(langs, np.log(np.maximum(prior, 0.5) / prior.sum()), tables)


def score_words(words: list[str], model: Model) -> np.ndarray:
    """A row for each word: its log frequency in each language, or that of its longest known n-grams on average; zeros if not a letter of it is known."""
    out = np.zeros((len(words), len(model.langs)), np.float32)
    known, matrix = model.tables.get(0, ({}, None))
    left = []
    for i, w in enumerate(words):
        k = known.get(w)
        if k is None:
            left.append((i, f"<{w}>"))
        else:
            out[i] = matrix[k]
    for n in LENGTHS:
        if not left or n not in model.tables:
            continue
        entries, matrix = model.tables[n]
        rest, at, rows, starts = [], [], [], []
        for i, w in left:
            found = [k for j in range(n == 1, len(w) - n + (n > 1)) if (k := entries.get(w[j : j + n])) is not None]
            if found:
                at.append(i), starts.append(len(rows))
                rows += found
            else:
                rest.append((i, w))
        if at:
            sums = np.add.reduceat(matrix[rows], starts, axis=0)
            out[at] = sums / np.diff([*starts, len(rows)])[:, None]
        left = rest
    return out


def _predict(sent, at: int):
    def run(batches):
        model: Model = sent.value
        memo: dict[str, int] = {}
        scores = np.zeros((0, len(model.langs)), np.float32)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = [words_of(t) for t in batch.column(at).to_pylist()]
                new = list(set().union(*texts) - memo.keys())
                if len(memo) + len(new) > REMEMBER:
                    memo, scores = {}, scores[:0]
                    new = list(set().union(*texts))
                memo.update(zip(new, range(len(memo), len(memo) + len(new))))
                scores = np.concatenate([scores, score_words(new, model)])
                langs, values = [], []
                for ws in texts:
                    if not ws or not model.langs:
                        langs.append(UNDETERMINED), values.append(0.0)
                        continue
                    each = scores[np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))]
                    total = model.prior + each.sum(axis=0, dtype=np.float64)
                    best = int(np.argmax(total))
                    langs.append(model.langs[best])
                    values.append(float(each.any(axis=1).mean() / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(values, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score of each whole text (columns of these names are replaced).

    lang_pred: the learned language with the highest sum of word scores and prior; score: its
    posterior share times the share of words of which a letter is known at least. Null text or no
    letter: `und`, 0. Letters of which nothing is known: the most frequent language, 0. Equal sums: the language that sorts first. A model of no languages gives `und`.
    Only text is read; null and repeated ids stay.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(trimmed(_predict(sent, docs.columns.index("text"))), schema)


def predictions(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the other folds of the same table."""
    model = learn(docs, sample)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
