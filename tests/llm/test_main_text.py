import html
import re
import time

from pagewarden.llm import main_text as M
from pagewarden.llm import media

from .texts import saved

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad --><div class="ad">Buy these now please.</div>
<article><h1>Head line</h1><p><b>First &amp; second
 part<br><p>Third&nbsp;part, with a <a href="x">link</a>.</p><div class="ad">an advert inside</div><p>x</p></article>
<section id="comments"><p>I think that this is a very long comment of a reader who has much to say about it all.</p></section>
<footer>&copy; example</footer></body></html>"""


def test_page():
    assert M.main_text(PAGE) == "Head line First & second part Third part, with a link. x"
    assert M.main_text("") == "" and M.main_text(None) == "" and M.main_text("<") in ("", "<")


def test_marks_end_with_their_paragraph_and_layout_classes_are_none():
    article = f"<h1>One two three four</h1><p>{'word ' * 40}</p><p>{'more ' * 30}</p>"
    want = M.main_text(f"<article>{article}</article>")
    assert want.count("word") == 40 and want.count("more") == 30
    for before, after in (
        ('<p class="notice">Ad now.<article>', "</article>"),
        ('<body class="has-sidebar"><article>', "</article></body>"),
        ('<body class="sidebar"><article class="post comment-enabled">', "</article></body>"),
        ('<div class="header-sidebar"><main>', "</main></div>"),
        ('<div class="no-sidebar"><article>', "</article></div>"),
    ):
        assert M.main_text(before + article + after).endswith(want), before
    blocks = M.blocks(f'<p class="ad">Buy<div id="content" class="no-sidebar">{article}</div>')
    beside = [M.NAMES.index(n) for n in ("beside", "named")]
    assert [sum(f[i] for i in beside) for _, f, _ in blocks] == [1, 0, 0, 0]


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen."
MENU = '<nav><ul><li><a href="/a">Menu</a><li><a href="/b">two</a></ul></nav>'
FOOT = "<footer>foot note</footer>"


def test_malformed_and_oddly_classed_pages():
    """Pages and the text that a reader would call the article."""
    for page, want in (
        (f"{MENU}<article><p>{LONG}<p>{LONG}<p>{LONG}</article>{FOOT}", [LONG] * 3),
        (f'{MENU}<article><p><a href="/x">see<p>{LONG}</p><p>{LONG}</p></article>{FOOT}', [LONG, LONG]),
        (f'{MENU}<article><a name="top"><p>{LONG}</p><p>{LONG}</p></article>{FOOT}', [LONG, LONG]),
        (f'{MENU}<article><p>{LONG} <a href="/x">see</p><p>{LONG}</p><p>{LONG}</p></article>{FOOT}', [f"{LONG} see", LONG, LONG]),
        (f"{MENU}<article><ul><li>{LONG}<li>{LONG}</ul><p>{LONG}</article>{FOOT}", [LONG] * 3),
        (f'<p class="share">Share now<article><p>{LONG}</p><p>{LONG}</p></article>{FOOT}', [LONG, LONG]),
        (f'<p class="ad">Ad<div id="content"><p>{LONG}</p><p>{LONG} {LONG}</p></div>', [LONG, f"{LONG} {LONG}"]),
        (f'{MENU}<article class="post-comment-free"><p>{LONG}</p></article>{FOOT}', [LONG]),
        (f'{MENU}<article class="ad notice sidebar"><p>{LONG}</p></article>{FOOT}', [LONG]),
        (f'{MENU}<article><p class="notice-board">{LONG}</p><p>{LONG}</p></article>{FOOT}', [LONG, LONG]),
        (f'{MENU}<article><p class="notice">{LONG}</p><p>{LONG}</p></article>{FOOT}', [LONG]),
        (f"<header><h1>Site</h1></header><article><header><h1>Head line</h1></header><p>{LONG}</p><footer>by</footer></article>", ["Head line", LONG]),
        (f"<header><p>Site</p><header><p>again</p></header><p>{LONG}</p></header><main><p>{LONG}</p></main>", [LONG]),
        (f'{MENU}<div class="has-sidebar"><article><p>{LONG}</p></article></div><div class="comment-list"><p>{LONG} {LONG}</p></div>', [LONG]),
        (f'{MENU}<article><p>{LONG}</p><div class="ad-box">{LONG}</div><section id="comments"><p>{LONG}</p></section><p>{LONG}</p></article>', [LONG, LONG]),
    ):
        assert M.main_text(page) == " ".join(want), page


def test_the_tree_fits_its_table_and_splits_on_density():
    rows = [b for p in M.labelled_pages() for b in M.blocks(p)]
    right = sum(M.decided(M.tree(), f) == y for _, f, y in rows)
    assert right / len(rows) > 0.97

    def used(t):
        return set() if len(t) == 1 else {M.NAMES[t[0]]} | used(t[2]) | used(t[3])

    assert used(M.tree()) >= {"beside", "words", "links", "inside", "notice", "under_comments"} and used(M.tree()) & {"words_before", "words_after", "links_before", "links_after"}


def test_names_alone_dont_decide():
    """Articles in containers with marked names, and boilerplate without any mark."""
    body = f"<h1>Head of it</h1><p>{LONG}</p><p>{LONG} {LONG}</p><p>{LONG}</p>"
    want = f"Head of it {LONG} {LONG} {LONG} {LONG}"
    for page in (
        f'{MENU}<div class="social-science">{body}</div>{FOOT}', f'{MENU}<section id="menu-recipes">{body}</section>{FOOT}', f'{MENU}<div class="widget-container content">{body}</div>{FOOT}', f'<form id="aspnetForm">{MENU}<div>{body}</div>{FOOT}</form>',
        f"{MENU}<article>{body}</article><div><h3>Comments</h3><p>{LONG}</p><p>{LONG} {LONG}</p></div>{FOOT}", f"<p>We use cookies to improve this site. Accept all cookies?</p><article>{body}</article>{FOOT}", f'{MENU}<p title="x>{LONG}</p><article>{body}</article>',
    ):
        assert M.main_text(page).endswith(want) and '<' not in M.main_text(page), page[:80]
        assert "cookies" not in M.main_text(page) and M.main_text(page).count("fourteen") <= 5
    comments = f'{MENU}<article><p>{LONG}</p></article><section id="comments">' + f"<p>{LONG} {LONG}</p>" * 9 + "</section>"
    assert M.main_text(comments) == LONG


def test_hard_pages_take_time_in_proportion():
    for source in ("<a " * 333_333, "<div>" * 200_000, "<main>" * 160_000, "<div class=ad><main>" * 50_000, "<!--" * 250_000, '<p title="x>Hello ' * 60_000, "<div>" * 60_000 + "</p>" * 90_000 + "</div>" * 60_000, "<article><h3>Comments</h3>" * 40_000, "<a href=x>" * 90_000):
        began = time.process_time()
        M.main_text(source)
        assert time.process_time() - began < 5, source[:20]
        began = time.process_time()
        media.parts(source)
        assert time.process_time() - began < 5, source[:20]


def test_on_given_pages_against_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = re.sub(r"</?(?:p|h1|br)>", " ", article)
        text = re.sub(r"<[^>]*>", "", text)
        assert M.main_text(r.html) == " ".join(html.unescape(text).split())


def test_query(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "word " * 90000 + "</p>"), (1, "u", PAGE)], "page_id bigint, url string, html string")
    clash = pages.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(0))
    rows = M.query(spark, saved(spark, tmp_path, pages=clash)).collect()
    assert len(rows) == 5
    assert {(r.page_id, r.n_chars) for r in rows} == {(1, 56), (2, 0), (3, 0), (None, 449_999)}
    assert M.extract(clash).columns == ["page_id", "url", "n_chars", "text"]
    assert M.extract(pages.where("false")).count() == 0
