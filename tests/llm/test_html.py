import itertools
import random
import re
from html import unescape
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.llm.html_text import extract_text, main_text
from millrace.llm.maxflow import _cut, label


def energy(own, edges, labels):
    return sum(abs(v) for v, x in zip(own, labels, strict=True) if (v > 0) != x and v) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_cut_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        own = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        best = min(energy(own, edges, x) for x in itertools.product([True, False], repeat=n))
        for f in (label, _cut):
            assert abs(energy(own, edges, f(own, edges)) - best) < 1e-9


PAGES = [
    (None, ""),
    ("", ""),
    ("<p>Plain page with only a paragraph of text.</p>", "Plain page with only a paragraph of text."),
    ("<title>T</title><script>var a='<p>no</p>'</script><style>p{}</style><p>Yes &amp; no&nbsp;&lt;b&gt;\n  here it is.</p>", "Yes & no <b> here it is."),
    ('<nav><a href="/a">Home</a></nav><article><h1>Title</h1><p>One <b>bold</b>word and more.<p>Two<br>lines of it.</article><footer>(c) 2024 all of it</footer>', "Title\nOne boldword and more.\nTwo lines of it."),
    ('<article><p>Text of the article here.</p><section class="comments"><p>A reader says a long thing with very many words in it, really.</p></section></article>', "Text of the article here."),
    ('<div class="cookie-notice"><p>We use cookies. Accept them all please now.</p></div><div id="content"><p>The article text is here, and it is rather long.</p></div><aside class="sidebar">Side text.</aside>', "The article text is here, and it is rather long."),
    ('<article><p>Kept text of some length.</p><form><label>Name</label><input><button>Send this</button></form><div class="ad">Buy our goods today, they are the best ones.</div><p>More text kept.</p></article>', "Kept text of some length.\nMore text kept."),
    ("<article><p>Cut off text that ends in an entity &am", "Cut off text that ends in an entity &am"),
    ("<article><p>Cut off in a tag <a href='x", "Cut off in a tag"),
    ("<article><p>A stray < sign and 1 < 2 here.</p><!-- <p>no</p> --></article>", "A stray < sign and 1 < 2 here."),
    ('<div class="page has-sidebar"><main><p>Text beside a sidebar, some words.</p></main><div class="reader-comments"><p>First, I say, of all of the readers here!</p></div></div>', "Text beside a sidebar, some words."),
    ('<article><p>Long <a href="x">link</a> text.</p><p>Same.</p><p>Same.</p></article>', "Long link text.\nSame.\nSame."),
]


def test_pages(spark):
    df = spark.createDataFrame([(i if i else None, f"u{i}", h) for i, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = extract_text(df).collect()
    assert [r.text for r in sorted(out, key=lambda r: int(r.url[1:]))] == [t for _, t in PAGES]
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract_text(df.limit(0)).count() == 0


RAW_PAGES = [
    ("<script>for(i=0;i<n;i++){f(i)}</script><p>Article text of some length.</p>", "Article text of some length."),
    ("<p>Text that stands before.</p><SCRIPT>if(a<b&&c)d='x'</Script ><p>Text that comes after.</p>", "Text that stands before.\nText that comes after."),
    ("<script><!-- hide\nf()</script><p>Article text of some length.</p>", "Article text of some length."),
    ("<script><!-- <script>f()</script> g() --></script><p>Article text of some length.</p>", "Article text of some length."),
    ("<script><!--> <script> f()</script><p>Article text of some length.</p>", "Article text of some length."),
    ("<script>t='</scripts>';i<n</script><style>a<b{}</style><title>x <y</title><textarea>i<n <!-- </textarea><p>Article text of some length.</p>", "Article text of some length."),
    ("<template><script>i<n;t='</template>'</script></template><p>Article text of some length.</p>", "Article text of some length."),
    ("<p>Text that stands before.</p><script>f(i<n)<p>never closed, as browsers read it</p>", "Text that stands before."),
    ("<p>The area is <math><mi>r</mi><mo>+</mo><mn>1</mn><annotation>r+1</annotation></math> for all of them.</p>", "The area is r+1 for all of them."),
]


def test_raw_elements_end_at_their_own_end_tag():
    for html, text in RAW_PAGES:
        assert main_text(html) == text, html


LEAD = "The article text is here, and it is rather long for a line of a page."
NAMED = [
    '<article class="post tag-news">{}</article>',
    '<article class="post category-reviews">{}</article>',
    '<article class="hentry tag-social category-menu">{}</article>',
    '<article id="post-12" class="type-post status-publish format-standard tag-popular tag-comments">{}</article>',
    '<body class="has-sidebar menu-open modal-closed">{}</body>',
    '<main id="search" class="widget-area">{}</main>',
    '<div class="sidebar-right social"><article>{}</article></div>',
    '<article><section id="discussion"><h2>Discussion</h2>{}</section></article>',
    '<article><section id="reviews">{}</section></article>',
    '<article><div class="section" id="related-studies">{}</div></article>',
    '<article><h2 id="comments">On comments and navigation menus</h2>{}</article>',
    '<article><div class="entry tag-ads">{}</div></article>',
    '<article><div class="post-body promoted-topic">{}</div></article>',
    '<div class="layout-sidebar"><div class="content">{}</div></div>',
    '<article><div id="adapter" class="loading shadow">{}</div></article>',
]
BOILER = [
    '<div class="{}"><p>Some words that no reader came for, written out in full.</p></div>'.format(n)
    for n in ("ad", "ads-top", "ad_slot_3", "adSlot", "cookie-notice", "cookieBanner", "site-footer", "main-nav", "navbar navbar-dark", "newsletter-signup", "sidebar", "left-sidebar", "comments", "comment-list", "reader-comments", "related", "related-posts widget", "breadcrumbs", "share", "social-share", "promo", "sponsored", "popup", "pagination")
] + [
    '<section id="discussion"><div class="comment"><p>A reader says a long thing with very many words in it, really.</p></div></section>',
    '<div id="responses"><ul><li><p>First, I say, of all of the readers here, and so on!</p></li></ul></div>',
    '<div class="reviews"><div class="review-author">Ann</div><p>I have read all of it and I did like it very much.</p></div>',
]


@pytest.mark.parametrize("page", NAMED)
def test_names_do_not_hit_articles(page):
    text = main_text("<nav><a href='/'>Home</a></nav>" + page.format(f"<p>{LEAD}</p><p>{LEAD}</p>") + "<footer>All of it by us</footer>")
    assert text.endswith(f"{LEAD}\n{LEAD}") and "Home" not in text and "by us" not in text


@pytest.mark.parametrize("part", BOILER)
def test_named_boilerplate_goes(part):
    for page in ("<article><p>{0}</p>{1}<p>{0}</p></article>", "<article><p>{0}</p><p>{0}</p></article>{1}", "<div>{1}</div><main><p>{0}</p><p>{0}</p></main>"):
        assert main_text(page.format(LEAD, part)) == f"{LEAD}\n{LEAD}", part


def test_comments_as_articles_and_cards():
    page = f"<main><article><p>{LEAD}</p></article>{{}}</main>"
    assert main_text(page.format('<div id="comments"><ol><li><article class="comment-body"><p>A long thing that a reader says, with words.</p></article></li></ol></div>')) == LEAD
    assert main_text(page.format('<div class="related"><article class="card"><p>Another story that one might read as well, some day.</p></article></div>')) == LEAD


def test_long_page():
    body = "".join(f"<p>Paragraph {i} of a very long page with words.</p>" for i in range(20_000))
    assert main_text(f"<nav>menu</nav><article>{body}</article>").count("\n") == 19_999
    assert main_text("<div>" * 5000 + "<p>Deep text of some length here.</p>") == "Deep text of some length here."


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no driver tables")
def test_known_articles(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert main_text(r.html) == "\n".join(p for p in parts if p)
