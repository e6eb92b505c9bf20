"""WARC and HTML operators."""

import gzip
import hashlib
import io

import pytest

from momenta.llm import html_text, queries, warc
from tests.conftest import SMALL

PAGES = "page_id long, url string, html string, payload string, digest string, uri string"


def pages(spark):
    body = "<p>" + "same words " * 20 + "</p>"
    rows = [(1, "http://a/ b", body), (2, "http://b/", body), (3, None, None), (4, "http://d/", ""), (5, "u", "short"), (6, "v", "short"), (7, "w", "é漢字" * 50), (2, "http://b/", body), (None, "n", body), (8, "big", "<p>" + "long text " * 200_000)]
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], PAGES)


def test_warc_round_trip(spark, tmp_path):
    df = pages(spark)
    archives = warc.write(df, f"file://{tmp_path}/w")
    got = warc.read(archives).collect()
    rows = df.collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == sorted([(0, "response", 0), (1, "response", 0), (2, "revisit", 1), (2, "revisit", 1), *((i, "response", 0) for i in range(3, 9))])
    html = {r.page_id: (r.html or "").encode() for r in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha256(html[r.page_id]).hexdigest())
        assert r.payload == (None if r.record_type == "revisit" else html[r.page_id])
    # each record is a gzip member that any reader takes
    data = b"".join(open(a.uri.removeprefix("file://"), "rb").read() for a in archives.collect())
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(rows)
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/none")).collect() == []


def test_archives_are_read_by_a_task_each(spark):
    """However short their names are, adaptive execution leaves archives apart."""
    archives = spark.range(1000).selectExpr("concat('file:///', id) AS uri", "1L AS records", "1L AS bytes")
    assert warc.read(archives).rdd.getNumPartitions() == 1000


def test_warc_reader_finds_damage():
    record = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    whole = gzip.compress(record) + gzip.compress(record)
    for size in (1, 7, len(whole)):
        assert [b for _, b in warc.members(iter([whole[k : k + size] for k in range(0, len(whole), size)]))] == [b"payload"] * 2
    with pytest.raises(ValueError):
        list(warc.members(iter([whole[:-20]])))
    with pytest.raises(ValueError):
        list(warc.members(iter([gzip.compress(record.replace(b"Content-Length: 7", b"Content-Length: 5"))])))
    assert list(warc.members(io.BytesIO(b""))) == []


PAGE = """<html><head><title>T</title></head><body><header><div class="logo">Site</div><nav><a href=x>Home</a> <a>News</a></nav></header><div id="cookie-banner">We use cookies.</div>
<main><h1>Title</h1><p>Para one &eacute; with <a href="q>r">a link</a> and
 more&nbsp;te<b>xt</b>.<p>Second para.<ul><li>One<li>Two</ul><div class="ad">Buy now</div><script>if(a<b){x("</p>")}</script><!-- <p>no</p> --></main>
<aside class=sidebar><p>Related thing is long and prose-like, with dots.</p></aside><section id="comments"><h3>Comments</h3><div class=comment><p>Reader says something long here, quite prose.</p></div></section>
<form><label>Mail</label></form><footer>(c) x</footer>"""


def test_main_text(spark):
    chain = html_text.model()
    text = lambda h: html_text.main_text(h, chain)
    assert text(PAGE) == "Title Para one é with a link and more text. Second para. One Two"
    assert [text(x) for x in (None, "", "   ", "<p>", "<div", "<!-- ", "<script>x")] == [""] * 7
    assert text("plain words") == "plain words"
    rows = html_text.extract(spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "", 3)], "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, len(text(PAGE))), (1, len(text(PAGE))), (2, 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_labels_of_unseen_layouts():
    wrong = total = 0
    chain = html_text.model()
    for found, label in html_text.labelled_pages(150, seed=123):
        guess = chain.viterbi(html_text.features(found))
        wrong += sum(a != b for a, b in zip(guess, label))
        total += len(label)
    assert total > 1000 and wrong / total < 0.01


PROSE = "<p>" + "This is a paragraph of prose that goes on for a while, with some commas, and then it ends. " * 3 + "</p>"
ARTICLE = "<h1>Title of it</h1>" + PROSE * 3
OTHER = "<p>XX Some other words that go on, and on, and on until the end of this one.</p>"
#: Layouts that are not the templates'. What has XX in it is no main text.
LAYOUTS = [
    f"<body class='has-header has-footer sidebar-right'><article class='post'>{ARTICLE}</article></body>",
    f"<body><div class='popular-science'>{ARTICLE}</div></body>",
    f"<body><article>{ARTICLE}</article><div class='userComments'>{OTHER * 2}</div></body>",
    f"<body><div class='siteHeader'><p>XX some site name and slogan here</p></div><div>{ARTICLE}</div></body>",
    f"<body><div class='cookieBanner'><p>XX We use cookies to improve things for you, accept.</p></div><div>{ARTICLE}</div></body>",
    f"<body><div>{ARTICLE}<div class='adBox'>XX Buy this now and here, it is cheap.</div>{PROSE}</div></body>",
    f"<body><main>{ARTICLE}</main><div class='disclaimer'>{OTHER}</div></body>",
    f"<body><article>{ARTICLE}</article><section id='responses'><h3>XX Responses</h3>{OTHER * 3}</section></body>",
    f"<body><div><a>XX Home</a> <a>XX News</a></div><div>{ARTICLE}{PROSE}</div><div>XX © 2020 Someone</div></body>",
    f"<html class='no-js promo'><body id='top-header'><div id='page'><div id='content'>{ARTICLE}<ul><li>One</li></ul></div><div id='sidebar'><h3>XX Recent</h3><ul><li><a>XX post one</a></li></ul></div></div></body></html>",
    f"<body><div class='post'>{ARTICLE}</div><div class='comments'>{('<div class=comment>' + OTHER * 3 + '</div>') * 5}</div></body>",
    f"<body class='news alert'><div class='related-wrapper'><div class='article'>{ARTICLE}</div></div></body>",
    f"<body><article>{ARTICLE}<p>Then <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article></body>",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_layouts_outside_the_templates(page):
    text = html_text.main_text(page, html_text.model())
    assert "XX" not in text and text.startswith("Title of it This is") and text.count("This is a paragraph") == page.count("This is a paragraph")
    assert "math" not in page or text.endswith("Then x=2 holds.")


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "<article>" + ARTICLE + "</article>"
    assert html_text.main_text(deep, html_text.model()).count("This is a paragraph") == 9
    long = "<article><h1>T</h1>" + "".join(f"<p>Sentence number {k} of a very long page, which is prose.</p>" for k in range(20_000)) + "</article>"
    text = html_text.main_text(long, html_text.model())
    assert text.startswith("T Sentence number 0 ") and text.count("Sentence number") == 20_000
    word = "<article><p>" + "x" * 500_000 + " and some more words that end here.</p></article>"
    assert html_text.main_text(word, html_text.model()).endswith("end here.")


def test_batched_training_steps_along_the_gradient():
    """One step of the training over padded pages goes where the sum of the pages' own gradients points."""
    import numpy as np

    pages = html_text.labelled_pages(12, seed=1, noise=0.3)
    one = html_text.train(pages, rounds=1, decay=0.0)
    zero = html_text.ChainModel(one.names)
    gw, gt = np.zeros_like(zero.w), np.zeros_like(zero.t)
    for found, label in pages:
        zero.gradient(zero.ids(html_text.features(found)), label, gw, gt)
    assert np.allclose(one.w, 0.5 * gw / np.sqrt(1e-8 + gw * gw)) and np.allclose(one.t, 0.5 * gt / np.sqrt(1e-8 + gt * gt))


def test_viterbi_and_gradient_against_enumeration():
    import itertools

    import numpy as np

    chain = html_text.ChainModel({"a": 0, "b": 1})
    rng = np.random.default_rng(0)
    chain.w, chain.t = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, (2, 2))
    fs = [["a"], ["a", "b"], ["b"], [], ["a"]]
    score = lambda y: sum(chain.w[chain.names[x], k] for f, k in zip(fs, y) for x in f) + sum(chain.t[p, q] for p, q in itertools.pairwise(y))
    paths = list(itertools.product((0, 1), repeat=len(fs)))
    assert tuple(chain.viterbi(fs)) == max(paths, key=score)
    gw, gt = np.zeros((2, 2)), np.zeros((2, 2))
    y = paths[11]
    ll = chain.gradient(chain.ids(fs), list(y), gw, gt)
    z = np.logaddexp.reduce([score(p) for p in paths])
    assert ll == pytest.approx(score(y) - z)
    eps = 1e-6
    chain.t[0, 1] += eps
    assert gt[0, 1] == pytest.approx((score(y) - np.logaddexp.reduce([score(p) for p in paths]) - ll) / eps, abs=1e-4)


def test_pages_of_the_table(spark):
    got = {r.page_id: r for r in queries.QUERIES["op6_html_text"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        assert got[r.page_id].n_chars == len(got[r.page_id].text) > 0
        assert "<" not in got[r.page_id].text[:50] or "&lt;" in r.html


@pytest.mark.parametrize("piece", ["<div>x y z. ", "<table><tr><td>word ", "<b><p>..", "<b>", "<section class='sidebar'>some text of it. "])
def test_time_grows_with_the_page_not_its_depth(piece):
    """A hundred thousand nested elements, with text at every depth, and closing tags that fit nothing."""
    import time

    began = time.time()
    text = html_text.main_text(piece * 100_000 + "</i></center>" * 1000, html_text.model())
    assert time.time() - began < 60 and len(text) < 2_000_000
