import html
import re

import pytest

from mailglass.llm import html_extraction as H
from mailglass.llm.queries import op6_line_blocks

BODY = "<p>First paragraph of the story with <b>bold</b> words and a <a href='/x'>link</a>, long enough to surge over the line.</p><p>Short.</p><p>Another paragraph &amp; more text&nbsp;here, which goes on for a good while longer.</p>"
WANT = "First paragraph of the story with bold words and a link, long enough to surge over the line. Short. Another paragraph & more text here, which goes on for a good while longer."
AROUND = {
    "menu": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>",
    "header": "<header><div>The Daily Site, all the news that we could find today for you</div></header>",
    "advert": "<div class='ad'>Buy this wonderful thing now, it is cheaper than it ever was before, really it is.</div>",
    "notice": "<div id=cookie-notice>We use cookies to make this site better for you and for all others.</div>",
    "side": "<aside>Most read: a long list of other things that you might want to read some day.</aside>",
    "form": "<form><label>Mail</label><input type=text><p>Sign up for our letter, it comes every week and it costs you nothing.</p></form>",
    "script": "<script>var a = '<p>not text, not text, not text, not text, not text, not text</p>';</script><style>p{color:red}</style>",
    "comments": "<section class='comments'><h2>Comments</h2><p>I liked this story very much, it was long and good and I will read it again.</p></section>",
    "footer": "<footer><p>Copyright, all rights reserved by the company that runs this very site, since long ago.</p></footer>",
    "comment": "<!-- a note that is rather long, so that it would surge if it were taken for text by mistake -->",
}


def test_article_without_its_surroundings():
    for name, part in AROUND.items():
        for wrap in ("article", "div"):
            assert H.main_text(f"<html><body>{part}<{wrap}>{BODY}</{wrap}>{part}</body></html>") == WANT, (name, wrap)
    assert H.main_text("<body>" + "".join(AROUND.values()) + f"<article>{BODY}</article>" + "".join(AROUND.values())) == WANT


def test_odd_pages(spark):
    pages = [None, "", "plain words only", "<p>unclosed <b>bold", "<div class=ad>only an advert</div>", "a < b and c > d", "<p title='a > b'>x</p>", "<!-- never closed <p>x", "<script>never closed", "<p>" * 3000 + "deep words" + "</p>" * 3000]
    want = ["", "", "plain words only", "unclosed bold", "", "a < b and c > d", "x", "", "", "deep words"]
    df = spark.createDataFrame([(i, p, "u", "clash") for i, p in enumerate(pages)], "page_id long, html string, url string, text string")
    rows = sorted(H.extract(df).collect(), key=lambda r: r.page_id)
    assert [r.text for r in rows] == want and [r.n_chars for r in rows] == [len(t) for t in want]
    assert H.extract(df.limit(0)).count() == 0


def test_pages_of_the_table(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op6_line_blocks(spark, folder).collect()
    assert len(rows) == len(pages)
    good = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", inner.replace("<b>", "").replace("</b>", ""))
        good += " ".join(html.unescape(plain).split()) == r.text
    assert good >= 0.98 * len(rows)


def test_wrappers_and_parts_of_an_article_stay():
    for name in ('class="content-sidebar-wrap"', 'class="layout with-sidebar"', 'class="post tag-comments"', 'class="sidebar"', 'id=social'):
        assert H.main_text(f"<body><div {name}><div><article>{BODY}</article></div><div class='sidebar'>Other things to read on some other day, a long list of them, really very long.</div></div></body>") == WANT, name
    for name in ('class="content-sidebar-wrap"', 'class="layout with-sidebar"', 'class="post tag-comments"'):
        assert H.main_text(f"<body><div {name}>{BODY}</div></body>") == WANT, name
    for part, text in (('<h2 id="related-work">Related work</h2>', "Related work"), ('<h2 id="comments">Comments</h2>', "Comments"), ('<section class="social-sciences"><p>Much was learned.</p></section>', "Much was learned.")):
        assert H.main_text(f"<article>{BODY}{part}</article>") == f"{WANT} {text}", part
    for name in ("ad", "ad-box-2", "site-header", "post-comments", "cookie-notice", "sidebar widget"):
        assert H.main_text(f"<article>{BODY}</article><div class='{name}'>x</div>".replace("</article>", f"<div class='{name}'>Away with this.</div></article>")) == WANT, name


def test_all_lines_of_an_article_stay():
    ad = "<div class='ad'>Buy this.</div>"
    assert H.main_text(f"<article><p>By A.</p>{ad * 4}<p>Short.</p>{ad * 4}{BODY}{ad * 4}<p>The end.</p></article>") == f"By A. Short. {WANT} The end."
    assert H.main_text(f"<main><p>By A.</p>{ad * 4}{BODY}{ad * 4}<p>The end.</p></main>") == f"By A. {WANT} The end."


PROSE = "This is a long paragraph of an article that tells a story with many words, so that it counts. "
STORY = "".join(f"<p>{PROSE}{i}</p>" for i in range(6))
WHOLE = " ".join(f"{PROSE}{i}" for i in range(6))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='page-wrapper no-sidebar'><div class='nav'>Home About</div>{STORY}</div>", WHOLE),
        (f"<div id='content' class='has-sidebar'>{STORY}</div>", WHOLE),
        (f"<div class='content-sidebar-wrap'><div class='layout with-sidebar'>{STORY}</div></div>", WHOLE),
        (f"<div>{STORY}<p class='notice-board-history'>The board is old.</p></div>", WHOLE + " The board is old."),
        (f"<div>{STORY}<p>The <span class='social'>contract</span> matters.</p></div>", WHOLE + " The contract matters."),
        (f"<div>{STORY}{3 * '<div class=ad>Buy</div>'}<p>The end came.</p></div><div class='footer'>c 2024</div>", WHOLE + " The end came."),
        (f"<div class='story'>{STORY}</div><article><h3>Another story.</h3></article>", WHOLE),
        (f"<article>{STORY}</article><article class='card'><p>Read another story soon.</p></article>", WHOLE),
        (f"<article>{STORY}</article><section id='comments'><p>{PROSE}</p></section>", WHOLE),
        (f"<article>{STORY}<div id='comments'><ol><li><article class='comment-body'><p>{PROSE}</p></article></li></ol></div></article>", WHOLE),
        (f"<article>{STORY}<article id='div-comment-5' class='comment-body'><p>{PROSE}</p></article></article>", WHOLE),
        (f"<article>{STORY}<article class='comment-free'><p>An inner part.</p></article></article>", WHOLE + " An inner part."),
        (f"<main>{STORY}<section class='user-comments'><p>{PROSE}</p></section></main>", WHOLE),
        (f"<article>{STORY}<div class='ad-slot-inline'>Buy this.</div><div class='js-newsletter-signup'>Write to us.</div><p>The end.</p></article>", WHOLE + " The end."),
        (f"<div class='sidebar'><article class='comment'>{STORY}</article></div>", WHOLE),
        (f"<main><div class='in-depth'>{STORY}</div><div class='body-text'><p>More of it.</p></div></main>", WHOLE + " More of it."),
        (f"<article>{STORY}<div class='comment'><p>{PROSE}</p></div><div class='reader-comment-3'><p>{PROSE}</p></div></article>", WHOLE),
        (f"<article>{STORY}</article><article><p>{PROSE * 3}</p></article>", WHOLE + " " + (PROSE * 3).strip()),
    ],
)
def test_ordinary_pages(page, text):
    assert H.main_text(f"<html><body>{page}</body></html>") == text
