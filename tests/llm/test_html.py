import html
import re

import numpy as np
import pytest

from llm import block_labeller as L
from llm.html_blocks import leaf_blocks
from llm.sample_pages import sample_pages


def texts(page):
    return [b.text for b in leaf_blocks(page)]


@pytest.fixture(scope="module")
def model():
    return L.train()


def test_blocks():
    assert texts("<p>a <b>b</b>&amp;c<br>d</p><div>e<p>f<p>g</div>h") == ["a b&c d", "e", "f", "g", "h"]
    assert texts('<img alt="Next > page" src="/a.jpg">text <a onclick="if(a>b)go()">go</a>') == ["text go"]
    assert texts("<!-- <p>no</p> --><title>t</title><script>var a='<p>x</p>';</script><style>p{}</style><p>yes</p><!-- open") == ["yes"]
    assert texts('<p>x</p><a href=/x title=Bob"s>l</a>' + '<p class="x">y</p>' * 3) == ["x", "l", "y", "y", "y"]
    assert texts("<p>cut &am") == ["cut &am"] and texts("<p>cut <a hre") == ["cut"] and texts("a < b &nbsp; c") == ["a < b c"]
    assert texts("") == texts("<p></p><br>") == []
    assert texts("<form>ask <textarea>no</textarea><select><option>no</select>more</form>") == ["ask", "more"]


def test_formulas_drawings_and_fallbacks_stay_in_their_line():
    formula = "<math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>n</mi></msup><annotation>x=2^n</annotation></math>"
    assert texts(f"<p>where {formula} holds</p><p>next</p>") == ["where x=2n holds", "next"]
    assert texts("<p>see <svg><title>no</title><desc>no</desc><g><text>axis <tspan>y</tspan></text><path d='M0'/></g></svg> here</p>") == ["see axis y here"]
    assert texts("<p>a <object data='/x'><param name='q'>fallback</object> b</p><noscript>turn on</noscript>") == ["a fallback b"]
    assert texts("<p>x<annotation>q</p>y") == ["x", "y"]


def test_hard_pages_take_linear_time():
    for page in ("<p " + 'a="b" ' * 20_000 + ">x", "<div>" * 20_000 + "x", "<" * 50_000, '<a title="' * 5_000 + "x", "<!--" * 20_000, "<b>" * 20_000 + "x", "&" * 50_000):
        leaf_blocks(page)


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(0)
    small = L.Labeller({k: v.astype(np.float64) for k, v in L.Labeller.fresh(5, seed=3).weights.items()})
    x, mask = L.padded([draw.normal(size=(n, 5)) for n in (4, 2, 5)])
    x, truth = x.astype(np.float64), draw.integers(0, 2, mask.shape).astype(float)

    def loss():
        p = small.chances(x, mask)[0]
        return -((truth * np.log(p) + (1 - truth) * np.log(1 - p)) * mask).sum() / mask.sum()

    found = small.gradients(x, mask, truth)
    for key, weight in small.weights.items():
        for at in [tuple(draw.integers(0, s) for s in weight.shape) for _ in range(4)]:
            old = weight[at]
            weight[at] = old + 1e-3
            up = loss()
            weight[at] = old - 1e-3
            down = loss()
            weight[at] = old
            assert abs((up - down) / 2e-3 - found[key][at]) < 1e-5, key


def test_held_out_pages(model):
    right = total = 0
    pages = list(sample_pages(150, seed=77))
    for (_, truth), marked in zip(pages, L.label(model, [b for b, _ in pages]), strict=True):
        right += sum(a == b for a, b in zip(truth, marked, strict=True))
        total += len(truth)
    assert right / total > 0.99


def test_test_pages(spark, sf, model):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in L.extract(pages, model).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        parts = re.split(r"</?(?:h1|p)>|<br>", re.sub(r"</?b>|<[^>]*$", "", inner))
        expected = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert (found[r.page_id].url, found[r.page_id].text, found[r.page_id].n_chars) == (r.url, expected, len(expected))


def test_other_layouts(model):
    page = ("<body><div class='site-header'>Name</div><ul class=menu><li><a href=/>Home</a><li><a href=/b>About us</a></ul>"
            "<div class='cookie-notice'>We use cookies, as all do.</div><div class=content><h1>A title</h1><p>First words of a text, and more.</p>"
            "<p>Second.</p></div><div id=comments><h3>Comments</h3><p>I do not agree with this at all, never.</p></div>"
            "<form class=search>Search <input></form><div class=footer>Copyright, all rights reserved.</div></body>")
    blocks = leaf_blocks(page)
    marked = L.label(model, [blocks])[0]
    assert [b.text for b, m in zip(blocks, marked, strict=True) if m] == ["A title", "First words of a text, and more.", "Second."]


def test_nulls_and_empty_tables(spark, model):
    frame = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article><p>Some text here.</p></article>", "y"), (1, "u", None, "x"), (2, "v", "", "z")],
                                  "page_id long, url string, html string, text string")
    found = sorted((tuple(r) for r in L.extract(frame, model).collect()), key=str)
    assert found == [(1, "u", "", 0), (1, "u", "", 0), (2, "v", "", 0), (None, None, "Some text here.", 15)]
    assert L.extract(frame.limit(0), model).collect() == []
