"""Block labeller: cutting pages, gradients, held-out accuracy on made-up pages, pages with known text."""

from __future__ import annotations

import os
import re
from html import unescape

import numpy as np
import pytest

from quire.llm import html

SF = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def model():
    return html.train()


def test_leaves():
    page = """<html><head><title>T &amp; t</title><script>var a="</p><p>x";</script><!-- <p>no</p> --></head>
    <body class="one two"><p>a <b>bold
    text<br><p>c&nbsp;d<ul><li>e<li><a href="/">f</a></ul><p>tail</body"""
    got = [(leaf.path[-1], leaf.text) for leaf in html.leaves(page)]
    assert got == [("title", "T & t"), ("p", "a bold text"), ("p", "c d"), ("li", "e"), ("li", "f"), ("p", "tail")]
    assert html.leaves(page)[1].path == ("html", "body", ".one", ".two", "p") and html.leaves(page)[4].linked == 1
    assert html.leaves("") == html.leaves("<p></p>") == html.leaves("<div") == []
    assert [leaf.text for leaf in html.leaves("a < b > c <3")] == ["a < b > c <3"]


def test_elements_that_are_no_raw_text():
    for name in ("object", "svg", "math", "select", "template", "noscript"):
        page = f"<div><p>a</p><{name}><p>b</p><p>c</div><p>d</p>"
        got = [(leaf.text, leaf.path) for leaf in html.leaves(page)]
        assert [t for t, _ in got] == ["a", "b", "c", "d"] and got[3][1] == ("p",), name
        closed = f'<p class="x">a <a href="/">l<{name}>b<{name}>c</{name}>d</{name}>m</a> e</p>'
        got = [(leaf.text, leaf.path) for leaf in html.leaves(closed)]
        assert " ".join(t for t, _ in got) == "a l b c d m e" and got[1][1] == ("p", ".x", name), name
        assert got[-1] == ("m e", ("p", ".x")), name
    drawing = "<p>a<svg><title>t</title><g><path d='M0'/><text>u</text></g><style>p{}</style></svg>b<math><mi>x</mi><mo>=</mo><mn>2</mn></math>c</p>"
    assert [leaf.text for leaf in html.leaves(drawing)] == ["a", "t u", "b", "x = 2", "c"]
    assert [leaf.text for leaf in html.leaves("<select><option>a<option>b</select><svg/><p>c")] == ["a", "b", "c"]


def test_all_words_of_class_id_and_role():
    listed = "flex flex-col items-center mt-4 px-2 sidebar"
    path = html.leaves(f'<div class="{listed}" id="related_box" role="note">x</div>')[0].path
    assert path == ("div", ".flex", ".flex", ".col", ".items", ".center", ".mt", ".4", ".px", ".2", ".sidebar", ".related", ".box", ".note")
    many = [f"w{i}" for i in range(5_000)]
    leaf = html.leaves(f'<div class="{" ".join(many)}">x</div>')[0]
    whole = html.Leaf(("div", *(f".{w}" for w in many)), "x", 0.0)
    assert len(leaf.path) <= html.PATH_BUCKETS + 2 and (html.vectors([leaf]) == html.vectors([whole])).all()


@pytest.mark.parametrize("name", ["script", "style", "textarea", "iframe"])
def test_unclosed_raw_text_ends_with_its_parent(name):
    page = f"<body><div><p>a</p><{name}>var x = 1; <p>no</p></div><p>b</p><{name}><b>no</b></{name} ><p>c</p></body>"
    assert [leaf.text for leaf in html.leaves(page.replace(f"<{name}><b>no</b></{name} >", ""))] == ["a", "b", "c"]
    assert [leaf.text for leaf in html.leaves(page.replace(f"<{name}>var x = 1; <p>no</p>", ""))] == ["a", "b", "c"]
    assert [leaf.text for leaf in html.leaves(f"<p>a</p><{name}>x<p>no")] == ["a"]


def test_article_with_unclosed_elements(model):
    maker = html.Maker(8)
    body = [maker.words(20, 60).replace("&amp;", "") for _ in range(12)]
    for name in ("object", "svg", "math", "script", "noscript", "template"):
        blocks = [f"<p>{b}</p>" for b in body]
        blocks[3] = f'<div class="figure"><{name} class="f"></div>' + blocks[3]
        page = html.leaves(f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1>{''.join(blocks)}</article></body></html>")
        kept = [leaf.text for leaf, m in zip(page, html.label_pages(model, [page])[0], strict=True) if m]
        assert kept == ["Title of it", *(" ".join(b.split()) for b in body)], name


def test_gradients():
    maker = html.Maker(3)
    pages = [maker.page() for _ in range(3)]
    x, mask = html.padded([html.vectors(p) for p, _ in pages])
    label = html.padded_labels([y for _, y in pages], x.shape[1])
    model = html.Labeller.fresh(5)
    for k, p in enumerate(model.parameters()):
        p64 = p.astype(np.float64)
        (model.inputs if k < 2 else model.states if k < 4 else [None])[k % 2 if k < 4 else 0] = p64
        if k == 4:
            model.last = p64

    def loss():
        s = model.run(x, mask)
        return -(mask * (label * np.log(s) + (1 - label) * np.log(1 - s))).sum() / mask.sum()

    slopes = model.slopes(x, mask, label)
    rng = np.random.default_rng(0)
    for p, slope in zip(model.parameters(), slopes, strict=True):
        for at in np.argsort(-np.abs(slope).ravel())[rng.integers(0, 10, 3)]:
            old = p.flat[at]
            p.flat[at] = old + 1e-3
            up = loss()
            p.flat[at] = old - 1e-3
            down = loss()
            p.flat[at] = old
            assert slope.flat[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-5)


def test_held_out_pages(model):
    maker = html.Maker(12345)
    pages = [maker.page() for _ in range(300)]
    marks = html.label_pages(model, [p for p, _ in pages])
    right = np.concatenate([m == (y > 0) for m, (_, y) in zip(marks, pages, strict=True)])
    assert right.mean() > 0.98


def test_padding_has_no_effect(model):
    maker = html.Maker(77)
    pages = [maker.page()[0] for _ in range(40)]
    together = html.label_pages(model, pages)
    assert all((html.label_pages(model, [p])[0] == t).all() for p, t in zip(pages, together, strict=True))


def test_odd_rows(spark, model):
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<p", "t"), (2, "v", "<article><h1>A&amp;B</h1><p>" + "x y. " * 9000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [r["text"] for r in html.extract(pages, model).collect()]
    assert got == ["", "", "", "A&B\n" + ("x y. " * 9000).strip()]
    assert html.extract(pages.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_pages_of_the_tables(spark, model):
    for r in html.extract(spark.read.parquet(SF), model).collect():
        page = spark_pages(spark)[r["row"]["page_id"]]
        main = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", main)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def spark_pages(spark, kept={}):  # noqa: B006
    if not kept:
        kept.update({r["page_id"]: r["html"] for r in spark.read.parquet(SF).collect()})
    return kept
