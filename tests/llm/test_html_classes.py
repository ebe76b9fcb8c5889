"""Equivalence classes against brute force, and what marks, shared paragraphs and deep pages do not take away."""

import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from helixframe.llm import html

PAGES = "page_id long, url string, html string"


def texts(spark, pages):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, PAGES)).collect()}


def test_classes_by_brute_force(spark):
    rows = [(i, "http://h.org/%d" % i, f"<body><nav><a>Home</a></nav><div><h1>T{i}</h1>{'<p>x</p>' * (i % 3 + 1)}{'<i>odd</i>' if i % 2 else ''}<p>own {i}</p></div><footer>Us</footer>") for i in range(9)]
    rows += [rows[0], (50, "http://g.org/", rows[1][2])]
    df = spark.createDataFrame(rows, PAGES)
    parsed = df.select("page_id", "url", "html", F.lit("h.org").alias("host")).where("page_id < 50").mapInArrow(html._parse_all, html.PARSED)
    got = defaultdict(set)
    for r in html.equivalence_classes(parsed).collect():
        got[r.vector].add((r.token, r.element))
    pages = [html.parse(t) for t in dict.fromkeys(r[2] for r in rows)]
    vectors, paths = defaultdict(list), set()
    for k, p in enumerate(pages):
        paths |= set(p.nodes)
        for t, n in Counter(p.nodes[e] if e >= 0 else html._text_token(p, -1 - e) for e in p.events).items():
            vectors[t].append((k, n))
    expected = defaultdict(set)
    for t, v in vectors.items():
        if len(v) >= max(html.SUPPORT, html.SHARE * len(pages)):
            expected[tuple(v)].add((t, t in paths))
    expected = {v: x for v, x in expected.items() if any(e for _, e in x)}
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values())) and len(expected) >= 2


def test_a_class_out_of_order_or_torn_is_no_template():
    page = html.parse("<body><nav>Home</nav><div><p>a</p><p>b</p></div><footer>Us</footer>")
    nav, us, body = page.nodes[page.at[0]], page.nodes[page.at[3]], page.nodes[0]
    turned = html.parse("<body><footer>Us</footer><div><p>a</p><p>b</p></div><nav>Home</nav>")
    of, size = {nav: 7, us: 7}, {7: 2}
    assert html.class_order(page, of, size)[7] != html.class_order(turned, of, size)[7] is not None
    inner = page.nodes[page.at[1]]
    assert html.class_order(page, {nav: 7, inner: 7, body: 8, page.nodes[page.up[page.at[1]]]: 8}, {7: 2, 8: 2})[7] is None  # p comes twice and hangs elsewhere


def test_template_text_goes_and_shared_paragraphs_stay(spark):
    page = lambda i, more: f"<body><div class=top>Menu {i}</div><article><h1>Title {i}</h1><p>Words of page {i} and some more of them</p>{more}<p>Read on at our site</p></article><footer>Us</footer>"
    got = texts(spark, [(i, f"http://h.org/{i}", page(i, "<p>Shared by most</p>" if i < 22 else "")) for i in range(24)])
    assert got[3] == "Title 3\n\nWords of page 3 and some more of them\n\nShared by most"
    assert got[23] == "Title 23\n\nWords of page 23 and some more of them"


def test_copies_stay_whole(spark):
    page = lambda i: f"<body><nav>Home</nav><article><h1>One title</h1><p>The very same text of some length</p></article><div class=ad>Buy {i}</div>"
    got = texts(spark, [(i, f"http://h.org/{i}", page(i)) for i in range(5)])
    assert set(got.values()) == {"One title\n\nThe very same text of some length"}


def test_two_pages_and_no_article_element(spark):
    page = lambda i: f"<body><div id=a><ul><li>One<li>Two</ul></div><div id=b><h2>Head {i}</h2>{''.join(f'<p>Sentence {k} of page {i} is here.</p>' for k in range(4 + i))}<p>All rights are ours</p></div><div id=c>Small print</div>"
    got = texts(spark, [(i, f"http://h.org/{i}", page(i)) for i in range(2)])
    assert got[0] == "\n\n".join(["Head 0", *(f"Sentence {k} of page 0 is here." for k in range(4))])


def test_marks_do_not_override_evidence(spark):
    words = " ".join(f"word{k}" for k in range(100))
    rows = [
        (1, "http://a.org/", "<article><h1>Head</h1><p class='alert'>Mind this.</p><ul class='tags'><li>one<li>two</ul><section id='related'><p>More of it</p></section></article>"),
        (2, "http://b.org/", f"<body><div class='text'><p>snippet</p></div><div><p>{words}</p></div>"),
        (3, "http://c.org/", "<article><p>Text</p><div class='ad'>Buy</div><div class='comments'><p>Nice</p></div></article>"),
    ]
    got = texts(spark, rows)
    assert got[1] == "Head\n\nMind this.\n\none\n\ntwo\n\nMore of it"
    assert words in got[2] and got[3] == "Text"


def test_deep_pages_take_time_in_proportion():
    began = time.time()
    for page in ("<div>x" * 10_000, "<i>x" * 10_000 + "<x-y>z" * 10_000 + "</b></i>" * 10_000, "<ul><li>" * 10_000):
        html.own_slot(html.parse(page))
    assert time.time() - began < 20


def test_repeated_rows_ties_long_texts_and_other_columns(spark):
    long = "word " * 200_000
    rows = [(1, "http://h.org/1", "<p>One</p>"), (1, "http://h.org/1", "<p>One</p>"), (2, "http://h.org/2", f"<article>{long}</article>"), (None, None, None), (3, "http://k.org", "<article>A</article><main>B</main><article>C</article>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit(1), "slot": F.lit("s"), "texts": F.lit(2), "nodes": F.lit(3), "token": F.lit("t"), "text": F.lit("no"), "n_chars": F.lit(-1)})
    got = html.extract(df).orderBy("page_id", "text").collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(None, 0), (1, 3), (1, 3), (2, len(long) - 1), (3, 4)] and got[-1].text == "A\n\nC"
