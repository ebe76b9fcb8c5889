"""License scan: TF-IDF cosine of runs of lines to notices and of whole texts to licence texts, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, small, stage, text_buffers, words

#: Notices by which files name their license.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Whole licence texts, by the names of their files.
TEXTS = tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
#: Least cosine of a run of lines, or of a whole text, to a template.
COSINE = 0.8
#: Names of licence files.
LICENSE_FILE = r"(?i)^(licen[cs]es?|copying|copyright|notice|unlicense)([._-].*)?$"

_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Terms:
    """Notices, then whole licence texts, as sparse vectors over their own terms."""

    def __init__(self):
        doc, _, h = words(*text_buffers(pa.array([t for _, t in TEMPLATES + TEXTS])), _BETWEEN)
        self.vocabulary = np.unique(h)
        self.tf = np.zeros((len(TEMPLATES) + len(TEXTS), len(self.vocabulary)))
        np.add.at(self.tf, (doc, np.searchsorted(self.vocabulary, h)), 1)
        #: Terms in a run of several lines at most: twice those of the longest notice.
        self.longest = 2 * int(self.tf[: len(TEMPLATES)].sum(axis=1).max())

    def places(self, h: np.ndarray) -> np.ndarray:
        """Each token's term, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)


def document_frequencies(files: DataFrame) -> DataFrame:
    """(term, n): in how many texts each term (by its hash) occurs, and under null the number of texts."""

    def count(batches):
        found, held, n = [], 0, 0

        def merged():
            terms, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.bincount(at, np.concatenate([x for _, x in found])).astype(np.int64))], ["term", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                doc, _, h = words(*text_buffers(batch.column(0)), _BETWEEN)
                _, at = np.unique(h ^ mix(doc.astype(np.uint64)), return_index=True)
                found.append(np.unique(h[at], return_counts=True))
                held += len(found[-1][0])
                n += batch.num_rows
                if held > 1_000_000:
                    yield merged()
                    found, held = [], 0
        if found:
            yield merged()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["term", "n"])

    return files.where("text IS NOT NULL").select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _runs(batch: pa.RecordBatch, terms: Terms, idf: np.ndarray, weights: np.ndarray) -> list[list[dict]]:
    """For each text the runs of lines, and the text itself, that reach COSINE if every unknown term has the least idf, 1.

    k: template; dot: product with it; known: squared norm of known terms; terms, counts: the unknown.
    """
    offsets, data = text_buffers(batch.column(1))
    doc, start, h = words(offsets, data, _BETWEEN)
    out: list[dict] = [{} for _ in range(batch.num_rows)]
    if not len(h):
        return [[] for _ in out]
    at = terms.places(h)
    short, seen = len(TEMPLATES), at >= 0
    products = weights * idf

    def put(s: int, e: int, low: int, high: int):
        known, n = np.unique(at[s:e][seen[s:e]], return_counts=True)
        unknown, m = np.unique(h[s:e][~seen[s:e]], return_counts=True)
        dot, norm = products[low:high, known] @ n, float(((n * idf[known]) ** 2).sum())
        best = int(np.argmax((dot / math.sqrt(norm + float((m**2).sum()))).round(9)))
        if dot[best] >= (COSINE - 1e-6) * math.sqrt(norm + float((m**2).sum())):
            found = {"k": low + best, "dot": float(dot[best]), "known": norm, "terms": unknown.view(np.int64).tolist(), "counts": m.tolist()}
            out[doc[s]].setdefault((found["k"], found["dot"], norm, unknown.tobytes(), m.tobytes()), found)

    # runs of lines: a token weighs idf ** 2 at least in the norm, so sums over lines bound the cosine from above
    line = doc + np.cumsum(data == 10)[start]
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    edges, of = np.r_[first, len(h)], doc[first]
    number = np.repeat(np.arange(len(first)), np.diff(edges))
    in_notice = seen & (terms.tf[:short].any(axis=0)[at])
    total = lambda x: np.r_[0, np.cumsum(x)]
    hits = np.bincount(number[in_notice], minlength=len(first))
    norms = total(np.add.reduceat(np.where(seen, idf[at] ** 2, 1.0), first))
    dots = np.stack([total(np.bincount(number[in_notice], products[k, at[in_notice]], len(first))) for k in range(short)])
    sums = total(hits)
    begin, size = np.flatnonzero(hits), 1
    while len(begin):
        end = begin + size
        near = (sums[end] - sums[begin] >= 3) & (hits[end - 1] > 0)
        b, e = begin[near], end[near]
        reach = (dots[:, e] - dots[:, b]).max(axis=0) >= (COSINE - 1e-6) * np.sqrt(norms[e] - norms[b])
        for s, t in zip(edges[b[reach]], edges[e[reach]]):
            put(int(s), int(t), 0, short)
        size += 1
        begin = begin[begin + size <= len(first)]
        begin = begin[(of[begin] == of[begin + size - 1]) & (edges[begin + size] - edges[begin] <= terms.longest)]
    # whole texts, by the exact norm of their known terms
    pair, n = np.unique(doc[seen] * len(idf) + at[seen], return_counts=True)
    d, t = pair // len(idf), pair % len(idf)
    norm = np.bincount(d, (n * idf[t]) ** 2, batch.num_rows) + np.bincount(doc[~seen], minlength=batch.num_rows)
    top = np.max([np.bincount(d, n * products[k, t], batch.num_rows) for k in range(short, len(products))], axis=0)
    for i in np.flatnonzero((top > 0) & (top >= (COSINE - 1e-6) * np.sqrt(norm))):
        put(int(np.searchsorted(doc, i)), int(np.searchsorted(doc, i, "right")), short, len(products))
    return [list(x.values()) for x in out]


def notices(files: DataFrame) -> DataFrame:
    """files with own_license and similarity: the template most similar to the text, if COSINE or more.

    Notices are compared with each line and with each run of lines (those without terms left out) of
    at most twice the longest notice's terms; licence texts with whole texts. Terms are runs of
    letters and digits; idf = ln((1 + n) / (1 + df)) + 1 over all texts. Of equally similar templates
    the first listed counts. Null or empty text: null and 0. Columns of these names are replaced.
    """
    files = files.drop("own_license", "similarity")
    spark = files.sparkSession
    df = stage(document_frequencies(files), "licenses-terms")
    terms = Terms()
    known = spark.createDataFrame([(int(x),) for x in terms.vocabulary.view(np.int64)], "term long")
    at = {r.term: r.n for r in df.join(F.broadcast(known), "term").collect()}
    n = df.where("term IS NULL").first()
    n = n.n if n else 0
    idf = np.log((1 + n) / (1 + np.array([at.get(int(x), 0) for x in terms.vocabulary.view(np.int64)]))) + 1
    weights = terms.tf * idf
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)
    run_type = pa.list_(pa.struct([("k", pa.int32()), ("dot", pa.float64()), ("known", pa.float64()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))
    sent = spark.sparkContext.broadcast((terms, idf, weights))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                runs = _runs(batch, *sent.value)
                hit = [i for i, x in enumerate(runs) if x]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int32())), pa.array([runs[i] for i in hit], run_type)], ["key", "runs"])

    near = files.where("text IS NOT NULL").select(F.md5("text").alias("key"), "text").mapInArrow(run, "key string, runs array<struct<k:int,dot:double,known:double,terms:array<long>,counts:array<long>>>")
    near = stage(near.dropDuplicates(["key"]).select("key", F.posexplode("runs").alias("run", "x")).select("key", "run", "x.*"), "licenses-runs")
    each = near.select("key", "run", "k", "dot", "known", F.explode_outer(F.arrays_zip("terms", "counts")).alias("u")).select("key", "run", "k", "dot", "known", F.col("u.terms").alias("term"), F.col("u.counts").alias("count"))
    needed = stage(df.join(each.select("term").distinct(), "term", "left_semi"), "licenses-needed")
    weight = F.col("count") * (F.log((1.0 + n) / (1 + F.col("n"))) + 1)
    scored = each.join(small(needed), "term", "left").groupBy("key", "run", "k", "dot", "known").agg(F.coalesce(F.sum(weight * weight), F.lit(0.0)).alias("rest"))
    scored = scored.withColumn("cosine", F.round(F.col("dot") / F.sqrt(F.col("known") + F.col("rest")), 9)).where(F.col("cosine") >= COSINE)
    best = stage(scored.groupBy("key").agg(F.max_by("k", F.struct("cosine", -F.col("k"))).alias("k"), F.max("cosine").alias("cosine")), "licenses-best")
    named = F.element_at(F.array(*[F.lit(x) for x, _ in TEMPLATES + TEXTS]), F.col("k") + 1)
    best = best.select(F.col("key").alias("_key"), named.alias("own_license"), F.round("cosine", 6).alias("similarity"))
    return files.withColumn("_key", F.md5("text")).join(small(best), "_key", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0))).drop("_key")


def scan(files: DataFrame) -> DataFrame:
    """files(doc_id, path, text) to doc_id, path, license, how, similarity, from_dir.

    how: `file` (a licence file by its name, with a notice), `header` (any other file with a notice),
    `inherited` (from the licence file in the nearest ancestor directory, itself included; of several
    there the one with the smallest path) or `none`. Null path: no directory, nothing to inherit.
    Null text has no notice. Repeated rows stay; an empty table gives no rows.
    """
    folder = F.regexp_replace(F.coalesce("path", F.lit("")), r"/?[^/]*$", "")
    name = F.element_at(F.split("path", "/"), -1)
    own = stage(notices(files.select("doc_id", "path", "text")).select("doc_id", "path", "own_license", "similarity", folder.alias("dir"), F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)).alias("is_file")), "licenses")
    given = own.where("is_file AND own_license IS NOT NULL").groupBy(F.col("dir").alias("from_dir")).agg(F.min_by("own_license", F.struct("path", "own_license")).alias("given"))
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = own.where("own_license IS NULL AND path IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.array_distinct(up)).alias("from_dir"))
    nearest = stage(dirs.join(given, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "given"), F.length("from_dir")).alias("near")), "licenses-dirs")
    out = own.join(small(nearest), "dir", "left")
    how = F.when(F.col("own_license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("near").isNotNull() & F.col("path").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.when(how == "inherited", F.col("near.given")).otherwise(F.col("own_license")).alias("license"), how.alias("how"), "similarity", F.when(how == "inherited", F.col("near.from_dir")).alias("from_dir"))
