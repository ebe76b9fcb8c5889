"""Other columns with clashing names, repeated rows and long texts for search, archives and licences."""

import hashlib

from pyspark.sql import functions as F

from helixframe.llm import licenses, topk, warc


def test_archives(spark):
    long = "long " * 400_000
    rows = [(i, f"http://h{i % 7}.org/{i}", f"<p>{i}</p>") for i in range(60)] + [(70, "http://h1.org/1", long), (70, "http://h1.org/1", long), (71, None, long), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(1), "digest": F.lit("d"), "first": F.lit(2), "bytes": F.lit(3), "n": F.lit(4), "payload": F.lit("p")})
    root, directory = warc.write_archive(df)
    for got in (warc.read_archive(root, directory).collect(), warc.lookup(spark, root, directory, df.select("url")).collect()):
        assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((i is None, i or 0) for i, _, _ in rows)
        assert {r.payload_digest for r in got if r.page_id in (70, 71)} == {hashlib.sha256(long.encode()).hexdigest()}
        assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (70, 71)) == [(70, "response", None), (70, "response", None), (71, "revisit", 70)]
    one = warc.lookup(spark, root, directory, [None, "http://h1.org/1", "http://h1.org/1", "http://zz.org/"]).collect()
    assert sorted(r.page_id or 0 for r in one) == [0, 1, 70, 70, 71]


def test_search_with_repeats_and_other_columns(spark, monkeypatch):
    rows = [(i % 50, [float(i % 9), float(i % 4), 1.0]) for i in range(120)] + [(0, []), (20, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"row": F.lit("r"), "size": F.lit(1), "vec": F.lit(2), "g": F.lit(3), "score": F.lit(4), "floor": F.lit(9.0)})
    expected = sorted(x for a, (i, v) in enumerate(rows) if i % 20 == 0 for x in [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted((-sum(int(64 * x) * int(64 * y) for x, y in zip(v, w)), j) for b, (j, w) in enumerate(rows) if a != b and len(w) == len(v))[:20])])
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == expected
    monkeypatch.setattr(topk, "BLOCK_ROWS", 30), monkeypatch.setattr(topk, "FIRST_ROWS", 50)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect())) == expected


def test_licences_with_repeats_and_other_columns(spark):
    wrapped = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful.\n */\nint x;\n"
    bsd = "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are\n// met:\n//\n// 1. Keep this.\n"
    rows = [(1, "a/x.c", wrapped), (1, "a/x.c", wrapped), (2, "a/y.c", bsd), (3, "a/LICENSE", "word " * 300_000 + "\nReleased under the MIT License\n"), (4, "a/z", None), (5, None, "")]
    rows += [(100 + i, f"f/{i}", f"plain words w{i} of a file\nand more v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({c: F.lit(1) for c in ("key", "_key", "run", "k", "term", "own_license", "similarity", "dir", "license", "near")})
    got = sorted((r.doc_id, r.license, r.how) for r in licenses.scan(df).where("doc_id < 100").collect())
    assert got == [(1, "GPL-3.0", "header"), (1, "GPL-3.0", "header"), (2, "BSD-3-Clause", "header"), (3, "MIT", "file"), (4, "MIT", "inherited"), (5, None, "none")]
