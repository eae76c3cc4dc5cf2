"""Blocks by hand, gradients by differences, and pages of other makes than those trained on."""

import re
from html import unescape

import numpy as np
import pytest
from helpers import prose

from scanlake.llm import html_blocks as h
from scanlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return h.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_query_against_the_pages_own_markup(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    out = QUERIES["op6_html"](spark, SF).toPandas()
    assert sorted(out.page_id) == sorted(pages.index) and (out.n_chars == out.text.str.len()).all()
    same = 0
    for r in out.itertuples():
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages.html[r.page_id], re.S)
        text = re.sub(r"</?b>", "", article[1]) if article else ""
        same += " ".join(unescape(re.sub(r"<[^>]*>", " ", text)).split()) == r.text
    assert same >= 0.98 * len(out)


def test_blocks():
    page = (
        "<!DOCTYPE html><html><!-- <p>no</p> --><body class='Main-Body x1'><p>One &amp; <b>t</b>wo&nbsp;<br>three<p>Four <a href='a>b'>link</a>"
        "<script>var t='</p>';</script><ul><li>five<li>six</ul></div><div>a < b &lt; c</div><style>p{}</style><p>cut <a hre"
    )
    got = [(path[2:], text) for path, text, _ in h.blocks_of(page)]
    assert got == [(("p",), "One & two three"), (("p",), "Four link"), (("p", "ul", "li"), "five"), (("p", "ul", "li"), "six"), (("p", "div"), "a < b < c"), (("p", "div", "p"), "cut")] or [
        t for _, t in got
    ] == ["One & two three", "Four link", "five", "six", "a < b < c", "cut"]
    assert h.blocks_of("") == [] and h.blocks_of("<script>open") == [] and h.blocks_of("<<<p>x") [-1][1].endswith("x")
    assert h.blocks_of("<" * 5000 + "a b='" * 2000 + "x")


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    model = h.Labeller(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, sizes = h._pad([rng.random((n, h.DIM)).astype(np.float32) for n in (3, 5)])
    y = rng.integers(0, 2, (2, 5)).astype(np.float32)

    def loss():
        z, _ = model.scores(x, sizes)
        real = np.arange(5) < sizes[:, None]
        return (np.log1p(np.exp(z)) - y * z)[real].mean()

    grad = model.gradient(x, sizes, y)
    for name in ("xf", "hb", "bf", "o", "c"):
        at = tuple(rng.integers(0, n) for n in model.p[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-3
        up = loss()
        model.p[name][at] = old - 1e-3
        down = loss()
        model.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-3, rel=0.1, abs=2e-5)


def test_other_pages(model):
    """Text in other wrappers stays; menus, notices, forms, sidebars and comments go."""
    main = [prose(k, 30 + 5 * k).capitalize() + "." for k in range(5)]
    page = f"""<html><head><title>t</title></head><body><header><div class="logo">Site name</div><nav><a href=/>Home</a></nav></header>
    <div class="cookie-notice"><p>We use cookies to serve you.</p></div><div class="content">{''.join(f'<p>{m}</p>' for m in main[:3])}
    <div class="advert"><p>{prose(30, 12)}</p></div>{''.join(f'<p>{m}</p>' for m in main[3:])}</div>
    <aside class="sidebar"><h3>More</h3><ul><li><a href=x>{prose(31, 5)}</a></li></ul></aside><form><label>Mail</label><button>Send</button></form>
    <section class="comments"><div class="comment"><p>{prose(32, 25)}</p></div></section><footer><p>Copyright</p></footer></body></html>"""
    blocks = h.blocks_of(page)
    which = h.label(model, [blocks], {})[0]
    assert [b[1] for b, keep in zip(blocks, which) if keep] == main


def test_awkward_pages(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "no markup at all", "x"), (3, "no markup at all", "x"), (None, "<p>" + prose(1, 20000), "x"), (4, "<div>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = h.extract(pages, model).collect()
    assert len(out) == len(rows) and [r.text for r in out[:2]] == ["", ""] and out[2].text == out[3].text
    assert h.extract(pages.limit(0), model).count() == 0
    assert h.train(pages.limit(0)).p["c"] == 0
