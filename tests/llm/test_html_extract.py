"""Main-text extraction: held-out accuracy on simulated pages, and fixed cases."""

import numpy as np
import pytest

from knotwork.llm import boosting, html_extract


@pytest.fixture(scope="module")
def model():
    return html_extract.fit()


def test_held_out_nodes(model):
    right = []
    for k in range(200):
        source, labels = html_extract.simulated(10**9 + k)
        page = html_extract.Page(source)
        assert len(page.parent) - 1 == len(labels)
        right += (page.kept(boosting.decide(model, page.features()))[1:] == np.array(labels)).tolist()
    assert np.mean(right) > 0.98


def test_decoding_has_no_contradictions():
    page = html_extract.Page("<body><div><p>a</p><p>b</p></div><p>c</p></body>")
    kept = page.kept(np.array([0.0, 1.0, -5.0, 1.0, 1.0, 2.0]))
    assert kept.tolist() == [True, True, False, False, False, True]
    for v in range(1, len(kept)):
        assert not kept[v] or kept[page.parent[v]]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy now, it is cheap.</div>
<article><h1>A title &amp; more</h1><p><b>First   paragraph, with some words in it, and then a few more of them to read.<br><p>Second &lt;one&gt;,&nbsp;which
goes over lines and has enough words to be a paragraph of its own.</p></article>
<footer>&copy; example.com &middot; All rights reserved.</footer></body>"""


def test_page(model):
    assert html_extract.extract([PAGE], model) == ["A title & more\nFirst paragraph, with some words in it, and then a few more of them to read.\nSecond <one>, which goes over lines and has enough words to be a paragraph of its own."]


def test_odd_input(model):
    assert html_extract.extract([None, "", "no markup  at\nall", "<", "</p></div>", "<p", "<script>a", "<a href='x>y"], model)[:3] == ["", "", "no markup at all"]
    deep = "<div>" * 3000 + "deep words" + "</div>" * 10
    assert len(html_extract.extract([deep], model)) == 1


def test_query_shape(spark, model):
    pages = spark.createDataFrame([(1, "u", PAGE, "mine"), (1, "u", PAGE, "mine"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_extract.main_text(pages, model=model).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), *[(1, len(rows[0]["text"] or rows[1]["text"]))] * 2]
    assert html_extract.main_text(pages.limit(0), model=model).count() == 0
