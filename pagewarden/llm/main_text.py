"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, which block-level tags divide. A block has its
number of words and its link density (share of words in links), those of the block before
and after it, whether it is a heading, how many articles are around it, how many elements
around it are marked as something beside the article (by tag, or by words in class, id or role; those
whose name says nothing else count apart from those that also say something else), the share of its words that
notices use, and whether it stands under a heading for comments. An element that holds most of the page's words outside
links isn't beside the article if its name says something else, too, or if it holds the page's main heading.
A decision tree (Gini impurity) is trained on the blocks of a small table of labelled
pages; the blocks it takes for content are the text.

Scripts, styles, comments and other elements whose content isn't text are left out.
Character references are decoded, white space in a block becomes one space, blocks are
joined by one space in page order. Null or empty HTML has an empty text. Rows are treated
one by one, whole; repeated rows and null ids are rows of their own, and a page takes time in proportion to its length.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import markup
from pagewarden.llm.common import spread, table

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul video audio canvas object title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INSIDE = frozenset(("article", "main"))
BESIDE = frozenset("nav header footer aside menu dialog button select search".split())
#: Tags that may hold a whole page.
AROUND = frozenset(("form", "fieldset"))
#: Words of names that only say that there is a part.
PARTS = frozenset("list box wrap wrapper container area section block bar inner outer item items group row col column panel top bottom left right main primary secondary site page global form links link text body wide full".split())
#: Words of headings over comments, and words of notices (fixed values).
COMMENTS = frozenset("comments comment responses replies discussion kommentare commentaires comentarios 댓글".split())
NOTICES = frozenset("cookie cookies consent gdpr privacy newsletter subscribe advertisement sponsored copyright © rights reserved 쿠키 저작권 datenschutz".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adbox banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay comment comments reply replies discussion disqus sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended subscribe newsletter signup login search footer header masthead copyright pagination toolbar skip".split()
)
#: Elements that aren't beside the article whatever their class, and words of a class that tell of a page's layout.
WHOLE = frozenset("html body main article".split())
_LAYOUT = re.compile(r"(?<!\S)(?:(?:has|no|with|without)[-_]\S+|\S+[-_](?:free|less|enabled|disabled|allowed|open|closed|on|off)(?!\S))", re.I)
#: A paragraph, heading or item is only beside the article if a whole name of its class or id is such a word.
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li td dd blockquote pre".split())
ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WORD = re.compile(r"[A-Za-z]+")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAMES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "inside", "beside", "named", "notice", "under_comments")
DEPTH = 9


def _marked(tag: str, attributes: str, inside: int) -> str:
    """How an element is beside the article: "tag", "only" (its name says nothing else), "also" (it says something else, too), or not at all."""
    if tag in BESIDE:
        return "tag" if tag != "header" or not inside else ""  # an article's own header belongs to it
    if attributes and tag not in WHOLE:
        rest, found = False, False
        for a, b, c in _MARK.findall(attributes):
            names = _LAYOUT.sub("", a or b or c)
            words = [w.lower() for w in (names.split() if tag in SINGLE else _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names)))]
            found = found or not BESIDE_WORDS.isdisjoint(words)
            rest = rest or any(w not in BESIDE_WORDS and w not in PARTS and len(w) > 1 for w in words)
        if found:
            return "also" if rest else "only"
    return "also" if tag in AROUND else ""


class Mark:
    """A marked element: how, the marked one around it, and the words and main headings before it and up to its end."""

    __slots__ = ("how", "up", "words", "heads", "words_end", "heads_end", "only", "also")

    def __init__(self, how: str, up: int, words: int, heads: int):
        self.how, self.up, self.words, self.heads = how, up, words, heads
        self.words_end = self.heads_end = -1


def blocks(source: str) -> list[tuple[str, list[float], bool]]:
    """(text, features, whether an element with data-main is around it) in page order."""
    out: list[list] = []
    held: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # tag; whether it is inside; its mark or -1; data-main
    known: dict[str, int] = {}  # how many of a tag are open
    marks: list[Mark] = []
    mark = -1  # the innermost open one
    soft: list[int] = []  # open ones by name
    inside = main = heading = words = heads = 0
    under = 0  # level of the heading for comments that is above, 0 if there is none
    depth_under = 0
    link = 0  # 1: in a link; 2: in one that isn't closed before the next, which counts to the end of its block
    events = list(markup.scan(source))
    ends, last = {}, None  # whether what comes after the a at a place, of all a and /a, is its end
    for i, (what, name, _) in enumerate(events):
        if name == "a" and what in ("open", "close"):
            if last is not None:
                ends[last] = what == "close"
            last = i if what == "open" else None

    def popped() -> str:
        nonlocal inside, main, mark, under
        tag, i, m, d = stack.pop()
        known[tag] -= 1
        inside, main = inside - i, main - d
        if m >= 0:
            marks[m].words_end, marks[m].heads_end = words, heads
            mark = marks[m].up
            if soft and soft[-1] == m:
                soft.pop()
        if len(stack) < depth_under:
            under = 0
        return tag

    def flush() -> None:
        nonlocal link, words, under, depth_under
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            n = text.count(" ") + 1
            m = min(len(html.unescape("".join(linked)).split()), n)
            low = [w.strip(".,:;!?()").lower() for w in text.split()]
            if heading:
                if n <= 4 and not COMMENTS.isdisjoint(low):
                    under, depth_under = heading, len(stack) - 1
                elif heading <= under:
                    under = 0
            words += n - m
            out.append([text, n, m / n, int(heading > 0), inside, mark, main > 0, sum(w in NOTICES for w in low) / n, int(under > 0)])
        held.clear()
        linked.clear()
        link = 0 if link == 2 and text else link

    for at, (what, name, rest) in enumerate(events):
        if what == "text":
            held.append(name)
            if link:
                linked += [name, " "]
        elif what == "raw":
            if name == "title":
                held.clear()
        elif what == "open":
            if name in BLOCKS:
                flush()
                # A block-level start tag ends an open paragraph or heading of its kind.
                if stack and stack[-1][0] == "p" and name != "br":
                    popped()
                # A list's item or a row's cell ends the one before.
                if name in ENDED and stack and stack[-1][0] in ENDED[name]:
                    popped()
                if name == "main":  # what holds it isn't beside it, whatever its name
                    while soft:
                        marks[soft.pop()].how = ""
                heading = int(name[1]) if name in HEADINGS else 0
            if name == "a":
                link = 1 if ends.get(at) else 2
                if not re.search(r"\bhref\b", rest, re.I):
                    link = 0
            if name in VOID or rest.endswith("/"):
                continue
            if name in BLOCKS:
                how, m = _marked(name, rest, inside), -1
                if how:
                    m = len(marks)
                    marks.append(Mark(how, mark, words, heads))
                    mark = m
                    if how != "tag":
                        soft.append(m)
                heads += name in ("h1", "main")
                i, d = int(name in INSIDE), int("data-main" in rest)
                stack.append((name, i, m, d))
                known[name] = known.get(name, 0) + 1
                inside, main = inside + i, main + d
        elif what == "close":
            if name == "a":
                link = 0
            elif name in BLOCKS:
                flush()
                heading = 0
                if known.get(name):
                    while popped() != name:
                        pass
    flush()
    while stack:
        popped()
    for x in marks:  # an element comes after those around it
        most = 2 * (x.words_end - x.words) > words
        if x.how == "also" and most or x.how == "only" and most and x.heads_end > x.heads:
            x.how = ""
        up = marks[x.up] if x.up >= 0 else None
        x.only = (up.only if up else 0) + (x.how in ("tag", "only"))
        x.also = (up.also if up else 0) + (x.how == "also")
    rows = []
    for k, (text, n, d, h, i, m, own, notice, below) in enumerate(out):
        before = out[k - 1] if k else (0, 0, 0.0)
        after = out[k + 1] if k + 1 < len(out) else (0, 0, 0.0)
        beside, named = (marks[m].only, marks[m].also) if m >= 0 else (0, 0)
        rows.append((text, [n, d, before[1], before[2], after[1], after[2], h, min(i, 1), min(beside, 2), min(named, 2), notice, below], own))
    return rows


def grown(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A tree: (feature, limit, tree up to the limit, tree above) or (label,)."""
    label = bool(2 * y.sum() > len(y))
    if depth == 0 or y.all() or not y.any():
        return (label,)
    best = None
    gini = lambda s: 2 * s.mean() * (1 - s.mean()) * len(s)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= limit
            cost = gini(y[left]) + gini(y[~left])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(limit), left)
    if best is None or best[0] >= gini(y) - 1e-12:
        return (label,)
    _, f, limit, left = best
    return (f, limit, grown(x[left], y[left], depth - 1), grown(x[~left], y[~left], depth - 1))


def decided(tree: tuple, features: list[float]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def labelled_pages() -> list[str]:
    """The training table: pages in the usual layouts, content marked with data-main. Only lengths and layout count, so words are numbered."""
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    menu = lambda n, w=1: "<ul>" + "".join(f'<li><a href="/{i}">{text(w)}</a></li>' for i in range(n)) + "</ul>"
    pages = []
    for k, sizes in enumerate(((1, 2), (8, 40, 3), (120,), (30, 30, 5, 60), (2,), (15, 250, 4, 1))):
        paragraphs = "".join(f"<p>{text(n)}</p>" for n in sizes)
        quoted = paragraphs + f"<blockquote>{text(sizes[0])}</blockquote><ul><li>{text(4)}</li><li>{text(9)} <a>{text(2)}</a></li></ul>"
        foot = f"{text(3 + 20 * k)} {text(2)}"
        pages += [
            f'<nav>{menu(4 + k)}</nav><div class="ad">{text(4 + 6 * k)}</div><article data-main><h1>{text(6)}</h1>{paragraphs}</article><footer>{foot}</footer>',
            f"<header><h1>{text(2)}</h1>{menu(5, 2)}</header><main data-main><h2>{text(3)}</h2>{quoted}</main><aside><h3>{text(2)}</h3><p>{text(30 + 10 * k)}</p>{menu(6, 5)}</aside><footer>{foot}</footer>",
            f'<div class="cookie-notice">{text(25)}<button>{text(1)}</button></div><div id="content" data-main><h1>{text(5)}</h1>{"".join(f"<p>{text(max(n, 12))}</p>" for n in sizes)}</div><div id="comments"><p>{text(3)}</p><p>{text(40 + k)}</p></div><div class="footer">{foot}</div>',
            f'<form><label>{text(2)}</label><p>{text(14)}</p></form><article><p data-main>{text(sizes[0])}</p><aside>{text(20)}</aside><div class="share">{menu(3)}</div><p data-main>{text(12)} <a>{text(3)}</a></p><section class="comments"><p>{text(60)}</p></section></article><div class="related">{menu(5, 7)}</div>',
            f"<article data-main><h1>{text(4)}</h1>{paragraphs}</article>",
            f'<header><h1>{text(3)}</h1></header><div id="wrap" class="no-sidebar"><article class="post-comment-free" data-main><header><h1>{text(5)}</h1></header>{paragraphs}<p class="notice-board">{text(sizes[0])}</p><p>{text(9)}<p>{text(7)}</article></div><div class="comment-list"><p>{text(44)}</p></div>',
            f'<div><p class="share">{text(2)}<article data-main><p>{text(sizes[-1])}</p><ul><li>{text(4)}<li>{text(8)}</ul></article></div>',
            f"<div data-main><p>{text(25 + 200 * k)}</p></div>",
            f"<div data-main><p>{text(14 + 300 * k)}</p><p>{text(16)}</p></div>",
            f"<div>{menu(9, 2)}</div><div data-main><p>{text(20 + 9 * k)}</p><p>{text(35)}</p></div><div>{menu(4, 3)}</div><p>{text(3)}</p>",
            # Boilerplate without a mark: menus, teasers of links, notices, comments under their heading.
            f"<p>{text(4 + 3 * k)} cookies {text(3)} privacy {text(k)}</p><div>{menu(6 + k)}</div><article data-main><h1>{text(5)}</h1>{paragraphs}<p>{text(9)} cookies {text(20)}</p></article><div><h3>Comments</h3><p>{text(30 + 9 * k)}</p><p>{text(12 + k)}</p></div>",
            f"<div><p>{text(6)} consent {text(2 + k)}</p></div><div data-main><h1>{text(4)}</h1><p>{text(30 + 5 * k)}</p><p>{text(18)} <a href=x>{text(2)}</a></p></div><div><h2>{text(1)} comments</h2><ul><li>{text(25)}</li><li>{text(8 + k)}</li></ul></div><p>© copyright {text(2 + k)}</p>",
            f"<div>{menu(5, 4)}</div><h2><a href=y>{text(6)}</a></h2><div data-main><h2>{text(7)}</h2><p>{text(22 + 11 * k)}</p></div><p><a href=z>{text(9)}</a> {text(1)}</p>{menu(3, 6)}<p>{text(2)} copyright {text(3)}</p>",
            # Links that are part of an article, also at its end.
            f"<nav>{menu(5)}</nav><article data-main><h1>{text(4)}</h1><p><a href=a>{text(5 + k)}</a></p><p>{text(3 + 8 * k)}</p><ul><li><a href=b>{text(3)}</a></li><li><a href=c>{text(4)}</a></li></ul></article>",
            f"<div>{menu(6, 2)}</div><article data-main><p>{text(20 + k)}</p><p><a href=a>{text(6)}</a></p><p>{text(2 + 4 * k)}</p></article>",
            f"<div>{menu(4 + k, 3)}</div><div data-main><p>{text(28)}</p><p>{text(13 + 3 * k)} <a href=a>{text(6)}</a></p><p>{text(17 + k)}</p></div>",
            # A link of a word or two before an article's text leads elsewhere.
            f"<nav>{menu(4)}</nav><article><p><a href=a>{text(1 + k % 2)}</a></p><p data-main>{text(13 + 5 * k)}</p><p data-main>{text(14)}</p></article><footer>{foot}</footer>",
            # Words of notices in an article.
            f"<nav>{menu(4)}</nav><article data-main><h1>{text(5)}</h1><p>{text(9 + 7 * k)}</p><p>{text(1)} rights reserved</p></article><footer>{foot}</footer>",
            f"<nav>{menu(4)}</nav><article data-main><p>copyright {text(2)}</p><p>{text(12)}</p><p>{text(4)} cookies {text(2 + k)}</p><p>{text(21)}</p></article><footer>{foot}</footer>",
            f"<p>{text(5 + k)} cookies {text(2)}</p><article data-main><p>{text(30 + k)}</p><p>{text(1)} cookies {text(3)}</p></article>",
            f"<p>{text(3)} privacy {text(2 + k)}</p><p>{text(7)} consent</p><article data-main><h1>{text(4)}</h1><p>© {text(3)}</p><p>{text(16 + k)}</p><p>{text(3)} privacy</p></article><p>{text(2)} rights reserved</p>",
            f"<nav>{menu(3)}</nav><div data-main><h1>{text(1 + k % 3)}</h1><p>{text(17 + 6 * k)}</p><p>{text(12)}</p></div><div>{menu(4, 2)}</div><p>{text(2)}</p>",
            # Content whose containers have marked names.
            f'<nav>{menu(4)}</nav><div class="social-science" data-main><h1>{text(5)}</h1>{paragraphs}<p>{text(24)}</p></div><div class="share">{menu(3)}</div><footer>{foot}</footer>',
            f'<form id="mainform"><div class="menu">{menu(6)}</div><div data-main><h1>{text(4)}</h1>{paragraphs}<p>{text(33)}</p></div><div class="footer">{foot}</div></form>',
            f'<section id="menu-recipes" data-main><h1>{text(3)}</h1><p>{text(16 + 7 * k)}</p><ul><li>{text(5)}</li><li>{text(6)}</li></ul></section><aside>{text(9)}</aside>',
        ]
    return pages


@functools.lru_cache(1)
def tree() -> tuple:
    rows = [b for page in labelled_pages() for b in blocks(page)]
    return grown(np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], bool))


def main_text(source: str | None, own: tuple | None = None) -> str:
    own = own or tree()
    return " ".join(text for text, features, _ in blocks(source or "") if decided(own, features))


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without their HTML and with the text. A column of the name out_col is replaced."""
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col).cast("string").alias("\x01html"))
    own = tree()

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(h.as_py(), own) for h in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], names=[*kept, out_col])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), f"`{out_col}` string"])
    return spread(rows).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
