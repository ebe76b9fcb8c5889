"""Licence notices over several lines, whole licence texts, and document frequencies of all terms."""

import math
import re
from collections import Counter

from helixframe.llm import licenses

FILES = "doc_id long, path string, text string"


def test_headers_over_lines_and_whole_texts(spark):
    texts = dict(licenses.TEXTS)
    header = "#!/bin/sh\n#\n# Licensed under the Apache License,\n# Version 2.0 (the \"License\"); you may\n# not use this file except in\n# compliance with the License.\n\necho zyx"
    unwrapped = " ".join(texts["MIT"].split())
    rows = [(1, "a/x.sh", header), (2, "b/LICENSE", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + unwrapped[12:]), (3, "c/COPYING", texts["GPL-2.0"]), (4, "d/LICENSE", texts["MPL-2.0"].replace("\n", " ")), (5, "e/x", "echo\nthe software\n\nis provided\nto you")]
    rows += [(100 + i, f"f/{i}", f"plain words w{i} of a file\nand more v{i}") for i in range(60)]
    got = {r.doc_id: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got[1] == ("Apache-2.0", "header") and got[2] == ("MIT", "file") and got[3] == ("GPL-2.0", "file") and got[4] == ("MPL-2.0", "file")
    assert {v for k, v in got.items() if k >= 5} == {(None, "none")}


def test_frequencies_of_all_terms(spark):
    """An ordinary word beside a notice weighs by its own frequency, not as if it were in no text."""
    notice = "Licensed under CC BY-NC 4.0 ordinary"
    rows = [(0, "a/x", notice), (1, "b/x", "Licensed under CC BY-NC 4.0 qqq")] + [(i, f"c/{i}", f"ordinary text {i}") for i in range(2, 3000)]
    got = {r.doc_id: r for r in licenses.notices(spark.createDataFrame(rows, FILES)).where("doc_id < 2").collect()}
    terms = lambda t: Counter(re.findall("[a-z0-9]+", t.lower()))
    df = Counter(w for _, _, t in rows for w in terms(t))
    vector = lambda t: {w: n * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in terms(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    a = vector("Licensed under CC BY-NC 4.0")
    for i in (0, 1):
        b = vector(rows[i][2])
        assert abs(got[i].similarity - sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b)) < 2e-6
    assert got[0].similarity > got[1].similarity
