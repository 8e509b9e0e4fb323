"""HTML extraction: messages against summing over all labellings, trees against plain rules, and pages kept from training."""

import html
import itertools
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewater.llm import dom, html_extract
from tidewater.llm.html_pages import labelled_pages


def test_messages_against_all_labellings():
    rng = np.random.default_rng(4)
    trees = [dom.parse(p) for p in ("<div><p>a</p><ul><li>b</ul></div><p>c", "<p>x", "")]
    f = html_extract.forest(trees)
    n = len(f.up)
    own, edge = rng.normal(size=(n, 2)), rng.normal(size=(n, 2, 2)) * 2
    node, pair, total = html_extract.marginals(f, own, edge)
    weights, node_sum, pair_sum = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(own[k, y[k]] for k in range(n)) + sum(edge[k, y[f.up[k]], y[k]] for k in range(n) if f.up[k] >= 0))
        weights += w
        for k in range(n):
            node_sum[k, y[k]] += w
            if f.up[k] >= 0:
                pair_sum[k, y[f.up[k]], y[k]] += w
    assert np.allclose(node, node_sum / weights) and np.isclose(total, np.log(weights))
    assert np.allclose(pair, pair_sum / weights)


def leaves(page):
    return [t for t in dom.parse(page).text if t]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<p>b &amp; c<br>d</p>e", ["a", "b & c d", "e"]),
        ("<p>x&nbsp;&#233;&eacute &ampy &am</p>", ["x éé &y &am"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ('<script>var t="</p><p>no</p>";</script><style>p{}</style><p title="a>b">y</p><!-- <p>n</p> --><!-->z', ["y", "z"]),
        ("<p>a <b>b</b><i>c</i>d<span>e</span></p></div></p>f", ["a bcde", "f"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", ["1", "2", "3", "4"]),
        ("<div>a<hr>b</div", ["a", "b"]),
        ("1 < 2 and <3 but <unknown-tag>in</unknown-tag> </", ["1 < 2 and <3 but in"]),
        ("<SCRIPT>x</Script ><DIV>ok</DIV><textarea>t<p></textarea><script>open", ["ok"]),
        ("<p>a<div>b</div></p>c", ["a", "b", "c"]),
        ("<div " * 3 + "x>y", ["y"]),
    ],
)
def test_blocks(page, blocks):
    assert leaves(page) == blocks


def test_deep_and_long_pages_take_linear_time():
    model = html_extract.trained()
    deep = "<article>" + "<div>" * 3000 + "text " * 50 + "</div>" * 3000 + "</article>"
    wide = "<article>" + "<p>some words here.</p>" * 20_000 + "</article>"
    assert html_extract.main_texts([deep, wide], model)[1].count("\n\n") == 19_999
    assert leaves("<a href='" * 20_000) == [] and leaves('<p title="' + "x" * 100_000) == []


def test_pages_kept_from_training():
    """Blocks of unseen labelled pages: at most one in 200 is judged wrongly."""
    trees = [dom.parse(p) for p in labelled_pages(300, seed=7)]
    marks = html_extract.trained().content(trees) >= 0.5
    told = np.array([x for t in trees for x in t.label]) == 1
    text = np.array([bool(x) for t in trees for x in t.text])
    assert 0 < told[text].mean() < 1 and (marks != told)[text].mean() < 0.005


PARTS = {
    "nav": '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>',
    "header": '<header class="site-header"><h1>The site</h1><p>Its motto stands here.</p></header>',
    "footer": "<footer>&copy; 2020 somebody. All rights.</footer>",
    "aside": '<aside class="sidebar"><h3>Read on</h3><p>Some words about another thing, and more of them.</p></aside>',
    "notice": '<div class="cookie-notice"><p>We use cookies. Please agree to them all.</p><button>Yes</button></div>',
    "advert": '<div class="ad">Buy this now, it is very cheap and good.</div>',
    "form": '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>',
    "comments": '<section class="comments"><h2>Comments</h2><div class="comment"><p>I read this and I liked it very much, thank you.</p></div><div class="comment"><p>Me too.</p></div></section>',
    "script": "<script>if (a < b) { document.write('<p>no</p>'); }</script><style>p { color: red }</style>",
}


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("wrapper", ["article", "main", 'div class="content"'])
def test_what_stands_around_the_main_text_goes(part, wrapper):
    tag = wrapper.split()[0]
    inner = ["<h1>A heading</h1>", "<p>First paragraph, which is not long.</p>", "<p>Second &amp; last.</p>"]
    wanted = "A heading\n\nFirst paragraph, which is not long.\n\nSecond & last."
    around = f"<html><body>{PARTS[part]}<{wrapper}>{''.join(inner)}</{tag}>{PARTS[part]}</body></html>"
    assert html_extract.main_texts([around], html_extract.trained()) == [wanted]
    if part in ("aside", "advert", "form", "script", "notice"):
        within = f"<html><body>{PARTS['nav']}<{wrapper}>{inner[0]}{inner[1]}{PARTS[part]}{inner[2]}</{tag}></body></html>"
        assert html_extract.main_texts([within], html_extract.trained()) == [wanted]


def test_query_against_the_article(spark, sf_dir):
    """The given pages mark their main text with article, which a plain rule can follow."""
    found = {r.page_id: r for r in html_extract.op11_html_extraction(spark, sf_dir).collect()}
    table = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    assert len(found) == len(table)
    for row in table:
        body = re.search(r"<article>(.*)</article>", row["html"], re.DOTALL)[1].replace("<br>", "\n")
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        wanted = "\n\n".join(b for b in blocks if b)
        got = found[row["page_id"]]
        assert (got.url, got.text, got.n_chars) == (row["url"], wanted, len(wanted))


def test_odd_rows(spark):
    rows = [(1, "u", None, 5), (1, "u", "", 5), (None, None, "<article><p>a b. 🦆</p></article>", None), (None, None, "<article><p>a b. 🦆</p></article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `odd name` int").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)})
    found = html_extract.extract_text(df, "html", html_extract.trained())
    assert sorted(map(repr, (tuple(r) for r in found.select("page_id", "url", "odd name", "text").collect()))) == sorted(map(repr, [(1, "u", 5, ""), (1, "u", 5, ""), (None, None, None, "a b. 🦆"), (None, None, None, "a b. 🦆")]))
    assert html_extract.extract_text(df.limit(0), "html", html_extract.trained()).count() == 0
    assert html_extract.fit([]).content([dom.parse("<p>a")]) == pytest.approx([0.5, 0.5, 0.5])
