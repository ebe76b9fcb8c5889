"""Scores by hand, and words of unknown scripts."""

import math

from pyspark.sql import functions as F

from helixframe.llm import langid
from tests.llm.test_operators import documents


def test_scores_by_hand(spark):
    """Counts, backoff and posterior done over with plain dictionaries."""
    langs = {"en": "the cat and the dog", "de": "der hund und die katze", "fr": "le chat et le chien"}
    rows = [(i, langs[x], x) for i in range(40) for x in langs for i in [i * 3 + list(langs).index(x)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    learned = [r for r in docs.withColumn("h", langid.held_out(F.col("doc_id"))).collect() if not r.h]
    counts = {x: {} for x in langs}
    for r in learned:
        for w in r.text.split():
            counts[r.lang].setdefault(0, {}).setdefault(w, 0)
            counts[r.lang][0][w] += 1
            for n in langid.LENGTHS:
                s = w if n == 1 else f"<{w}>"
                for k in range(len(s) - n + 1):
                    table = counts[r.lang].setdefault(n, {})
                    table[s[k : k + n]] = table.get(s[k : k + n], 0) + 1

    def frequency(kind, entry, x):
        names = set().union(*(counts[y].get(kind, {}) for y in langs))
        total = sum(counts[x].get(kind, {}).get(e, langid.UNSEEN) for e in names)
        return math.log(counts[x].get(kind, {}).get(entry, langid.UNSEEN) / total) if entry in names else None

    def word(w, x):
        if (f := frequency(0, w, x)) is not None:
            return f
        for n in langid.LENGTHS:
            s = w if n == 1 else f"<{w}>"
            found = [f for k in range(len(s) - n + 1) if (f := frequency(n, s[k : k + n], x)) is not None]
            if found:
                return sum(found) / len(found)
        return None

    for t in ("the cat", "katzen", "chiens thed", "q the", "die chat"):
        ws = t.split()
        total = {x: math.log(sum(r.lang == x for r in docs.where(~langid.held_out(F.col("doc_id"))).collect()) / len(learned)) + sum(word(w, x) or 0 for w in ws) for x in langs}
        best = max(sorted(total), key=total.get)
        share = sum(word(w, "en") is not None for w in ws) / len(ws) / sum(math.exp(v - total[best]) for v in total.values())
        got = langid.identify(documents(spark, [(1, t)]), model).first()
        assert got.lang_pred == best and abs(got.score - share) < 1e-4, t


def test_unknown_scripts_score_nothing(spark):
    docs = documents(spark, [(i, "the cat and the dog were out") for i in range(30)])
    got = langid.identify(documents(spark, [(1, "надо же"), (2, "the cat надо же"), (3, "12 !")]), langid.learn(docs)).orderBy("doc_id").collect()
    assert [(r.lang_pred, round(r.score, 3)) for r in got] == [("en", 0.0), ("en", 0.5), ("und", 0.0)]
