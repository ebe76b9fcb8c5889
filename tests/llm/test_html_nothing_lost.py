"""What pages of one host share inside their articles stays, and articles without a named element stay whole."""

import pytest

from helixframe.llm import html


def page(body):
    return f"<html><body><nav><a>Menu</a></nav>{body}<footer>Foot</footer></body></html>"


def extracted(spark, bodies, host="h.org"):
    rows = [(i, f"http://{host}/{i}", page(b)) for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("own", [1, 4])
def test_shared_paragraphs_of_two_articles_stay(spark, own):
    bodies = [f"<article><p>Shared lead paragraph of both</p>{''.join(f'<p>own text {i} number {k}</p>' for k in range(own))}</article>" for i in range(2)]
    got = extracted(spark, bodies)
    assert all(got[i] == "\n\n".join(["Shared lead paragraph of both", *[f"own text {i} number {k}" for k in range(own)]]) for i in range(2))


@pytest.mark.parametrize("pages", [1, 6])
def test_articles_without_a_named_element_stay_whole(spark, pages):
    bodies = [f"<div><h1>Head {i}</h1><p>intro {i}</p><div><p>long {i} {'word ' * 60}</p></div><p>outro {i}</p></div>" for i in range(pages)]
    got = extracted(spark, bodies)
    assert all(got[i] == "\n\n".join([f"Head {i}", f"intro {i}", f"long {i} {'word ' * 60}".strip(), f"outro {i}"]) for i in range(pages))


def test_what_nearly_every_page_of_a_host_repeats_is_template(spark):
    bodies = [f"<article><p>Sign up for news</p><p>own text {i}</p></article>" for i in range(12)]
    got = extracted(spark, bodies)
    assert all(got[i] == f"own text {i}" for i in range(12))
    assert set(extracted(spark, ["<article><p>One text</p></article>" + f"<nav>{i}</nav>" for i in range(12)]).values()) == {"One text"}
