import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from corpuslens.llm import catalog
from corpuslens.llm.html_text import FRAMES, Tree, blocks, extract, labelled_blocks, main_text, trained_tree


def text_of(page):
    return extract([page], trained_tree())[0]


@pytest.mark.parametrize("page, expected", [
    ("<article><h1>Title</h1><p>One&nbsp; &amp;\n two<br>three</p><p>Ok.</p></article>", "Title\nOne & two three\nOk."),
    ("<nav><a href=/>Home</a></nav><article><p>Body text</p></article><footer>&copy; us and more words</footer>", "Body text"),
    ("<article><p>Text</p><div class='comments'><p>First! nice one indeed</p></div></article>", "Text"),
    ("<div class=ad>Buy this very nice thing now</div><article><p>x</p></article>", "x"),
    ("<article><p><b>Never closed<br><p>next</p>", "Never closed\nnext"),
    ("<main><form>Your name <input></form><p>Main text</p></main>", "Main text"),
    ("<article><script>var t='</p>';</script><style>p{}</style><p>a<!-- no --> b</p></article>", "a b"),
    ("<article><aside>On the side there is this</aside><p>In</p></article>", "In"),
    ("<div class='cookie-notice'>We use cookies, accept them please</div><article><p>y</p></article>", "y"),
    ("<article><p>1 < 2 and 3 > 2 &lt;b&gt; &#233; &am</p></article>", "1 < 2 and 3 > 2 <b> é &am"),
    ("<header><h1>Site name</h1></header><article><header><h1>The title</h1></header><p>z</p></article>", "The title\nz"),
    ("<div class='page has-sidebar'><p class='msg'>Read on our other pages too</p><div class='article-body wide'><p>q r</p></div></div>", "q r"),
    ("<article><p>t</p><article class='comment'><p>I like this a lot</p></article></article>", "t"),
    ("", ""), ("<", ""), ("<script>never closed", ""),
])
def test_pages(page, expected):
    assert text_of(page) == expected


def test_blocks_do_not_cross_paragraphs_and_keep_order():
    assert [t for t, _ in blocks("<p>a <i>b</i><p>c</p>d<ul><li>e<li>f</ul>")] == ["a b", "c", "d", "e", "f"]


def test_tree_learns_its_table_and_unseen_pages():
    x, y = labelled_blocks()
    order = np.random.default_rng(1).permutation(len(y))
    cut = len(y) * 3 // 4
    tree = Tree(x[order[:cut]], y[order[:cut]])
    assert (tree.predict(x[order[cut:]]) == y[order[cut:]]).mean() > 0.98


def test_whole_table_against_its_markup(spark):
    rows = catalog.QUERIES["op2_html"](spark, SMOKE).join(
        spark.read.parquet(f"{SMOKE}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:  # these pages hold one article of headings and paragraphs
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(x for x in lines if x)
        assert r.n_chars == len(r.text)
    assert len(rows) == 50


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "<article><p>" + "lang " * 200_000 + "</article>"), (3, "<article><p>tie</article>"), (None, "<p>"),
            (4, "<div><div><p>" * 3000 + "<article>deep"), (5, "</p></div>" * 3000 + "<article>shallow")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("row", F.lit(1))
    got = [(r.page_id, r.text) for r in main_text(df).select("row.page_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (3, ("lang " * 200_000).strip()), (3, "tie"), (None, ""),
                                           (4, "deep"), (5, "shallow")], key=str)
    assert main_text(df.limit(0)).count() == 0


PARAGRAPHS = [" ".join(f"word{k}x{j}" for j in range(60)) for k in range(3)]


@pytest.mark.parametrize("name", ["footer-text", "sidebar-content", "cookie-text", "banner-text", "nav-content", "modal-body", "sidebarContent"])
@pytest.mark.parametrize("frame", ["<div>{}</div>", "<article>{}</article>", "<div class='post-body'>{}</div>", "<div id='post-12'>{}</div>"])
def test_furniture_named_with_an_article_word(name, frame):
    beside = f"<div class='{name}'><p>Some words about us and what we do on this site</p></div>"
    article = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    assert text_of(f"<body>{frame.format(article)}{beside}</body>") == "\n".join(PARAGRAPHS)
    assert text_of(f"<body>{beside}{frame.format(article)}</body>") == "\n".join(PARAGRAPHS)


TEXT, BODY = "\n".join(PARAGRAPHS), "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
NAV, FOOT = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>", "<footer>&copy; 2024 all rights</footer>"


@pytest.mark.parametrize("page, expected", [
    (f"<form>{NAV}<article><h1>T one</h1>{BODY}</article></form>", "T one\n" + TEXT),
    (f"<form action=x><div>{NAV}<div><h1>T one two</h1>{BODY}</div></div></form>", "T one two\n" + TEXT),
    (f"{NAV}<div class='legal-text'>{BODY}</div>{FOOT}", TEXT),
    (f"{NAV}<div class='read-more-body'>{BODY}</div>{FOOT}", TEXT),
    (f"{NAV}<div><h1>The title here</h1>{BODY}</div>{FOOT}", "The title here\n" + TEXT),
    (f"<div><h1>The title here</h1>{BODY}</div>", "The title here\n" + TEXT),
    (f"{NAV}<div class='content-wrapper'><h1>The title here</h1>{BODY}</div>{FOOT}", "The title here\n" + TEXT),
    (f"<article>{BODY}<h2>References</h2><ol><li><a href=/1>First paper about things by someone</a></li><li>"
     "<a href=/2>Second paper about other things</a></li></ol></article>",
     TEXT + "\nReferences\nFirst paper about things by someone\nSecond paper about other things"),
    (f"<article>{BODY}<p class='story-more'>{PARAGRAPHS[0]}</p></article>", TEXT + "\n" + PARAGRAPHS[0]),
    (f"<div>{PARAGRAPHS[0]}</div><div>{PARAGRAPHS[1]}</div><div>&copy; 2024 Company Inc. All rights reserved.</div>", "\n".join(PARAGRAPHS[:2])),
    (f"<article>{BODY}<form><label>Your name</label><p>Please subscribe to our letter now</p><button>Go</button></form></article>", TEXT),
    (f"<form>Search <input></form><div><h1>Title of it</h1>{BODY}</div>", "Title of it\n" + TEXT),
])
def test_real_shaped_pages(page, expected):
    assert text_of(f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>") == expected


@pytest.mark.parametrize("held", [FRAMES[2], FRAMES[5], FRAMES[8]])
def test_layouts_that_the_tree_has_not_seen(held):
    tree = Tree(*labelled_blocks(tuple(f for f in FRAMES if f != held)))
    x, y = labelled_blocks((held,))
    assert (tree.predict(x) == y).mean() > 0.9
