import random
import time

import pytest
from pyspark.sql import functions as F

from pagewarden.sources import dom, markup
from pagewarden.sources.selectors import Automaton, Compound, _chains

HARD = {
    "tags": "<a " * 333_333, "div": "<div>" * 200_000, "main": "<main>" * 160_000, "comments": "<!--" * 250_000, "quotes": '<p title="x>Hello ' * 60_000, "mixed quotes": "<p a='x\">" * 100_000, "closing": "<div>" * 60_000 + "</p>" * 100_000 + "</div>" * 60_000,
    "scripts": "<script>" * 120_000, "signs": "<" * 1_000_000, "values": '<a b="' * 150_000, "hidden end": "<a b='\"'>" * 60_000 + '<a b="', "declarations": "<!" * 500_000, "attributes": "<a " + "b " * 400_000 + ">", "cells": "<table><tr><td>" * 20_000,
}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_take_time_in_proportion(name):
    took = []
    for part in (4, 1):
        source = HARD[name][: len(HARD[name]) // part]
        began = time.process_time()
        tree = dom.elements_of(source)
        took.append(time.process_time() - began)
        assert sum(map(len, tree.texts)) <= len(source)
    assert took[1] < max(2.0, 8 * took[0]), took


def test_scan_keeps_texts_and_ends_tags_at_unquoted_signs():
    scan = lambda s: list(markup.scan(s))
    assert scan('a < b<p title="x>y">c') == [("text", "a < b", ""), ("open", "p", ' title="x>y"'), ("text", "c", "")]
    assert scan('<p title="x>Hello</p>') == [("open", "p", ' title="x'), ("text", "Hello", ""), ("close", "p", "")]
    assert scan("a<!--a-->d<!doctype html>e<? f ?>") == [("text", "a", ""), ("comment", "a", ""), ("text", "d", ""), ("declaration", "<!doctype html>", ""), ("text", "e", ""), ("declaration", "<? f ?>", "")]
    assert scan("<script>if (a<b) '</scriptx>'</SCRIPT >z") == [("open", "script", ""), ("raw", "script", "if (a<b) '</scriptx>'"), ("close", "script", ""), ("text", "z", "")]
    assert scan("a<p b") == [("text", "a", "")] and scan("<title>x") == [("open", "title", ""), ("raw", "title", "x"), ("close", "title", "")]
    assert markup.attributes(" A=1 a=2 b='x &amp; y' c d=\"\"") == {"a": "1", "b": "x & y", "c": "", "d": ""}


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []
        self.classes, self.depth = attrs.get("class", "").split(), 0 if up is None else up.depth + 1
        kids = up.kids if up else []
        self.child, self.of_type = len(kids) + 1, sum(k.tag == tag for k in kids) + 1
        self.older = list(kids)
        if up:
            kids.append(self)


def fits(node, chain):
    """By the definition: a chain's last compound, then what stands before it, tried at every place it may have."""
    sign, compound = chain[-1]
    if not compound.fits(node):
        return False
    if len(chain) == 1:
        return True
    if sign == " ":
        up, many = node.up, []
        while up is not None:
            many.append(up)
            up = up.up
    else:
        many = {">": [node.up] if node.up else [], "+": node.older[-1:], "~": node.older}[sign]
    return any(fits(m, chain[:-1]) for m in many)


SELECTORS = (
    "div", "*", "#a", ".x", "p.x.y", "div p", "div > p", "p + p", "p ~ .x", "div .x > p", "ul > li:first-child", "li:nth-child(2n+1)", "li:nth-child(odd) ~ li", "p:nth-of-type(2)", "[data-a]", "[data-a=u]", '[data-a~="v"]', "[data-a^=u], [data-a$='w']",
    "[data-a|=u]", "[data-a*=v]", "p:not(.x)", "div:not([data-a]) li + li", "div div div", "body > * > *", ":root", "ul *, p > *", "*:first-of-type > .y", "div>ul>li+li~li",
)


def test_automaton_is_the_definition():
    rng = random.Random(11)
    auto = Automaton(SELECTORS)
    for _ in range(60):
        nodes, source, stack = [], [], [None]
        for _ in range(rng.randint(1, 60)):
            if len(stack) > 1 and rng.random() < 0.4:
                source.append(f"</{stack.pop().tag}>")
                continue
            tag = rng.choice(["div", "p", "ul", "li", "body", "span"])
            if stack[-1] is not None and stack[-1].tag in dom.ENDS.get(tag, ()):
                source.append(f"</{stack.pop().tag}>")
            attrs = {k: rng.choice(v) for k, v in {"id": ["a", "b"], "class": ["x", "x y", "y  z"], "data-a": ["u", "u v", "u-v", "vw", ""]}.items() if rng.random() < 0.3}
            up = stack[-1]
            node = Node(tag, attrs, up)
            if up is None:
                tops = [n for n in nodes if n.up is None]
                node.child, node.of_type, node.older = len(tops) + 1, sum(n.tag == tag for n in tops) + 1, tops
            nodes.append(node)
            stack.append(node)
            source.append("<" + tag + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">")
        got = dom.Tree(auto).feed("".join(source)).columns
        assert got["tag"] == [n.tag for n in nodes]
        for n, bits in zip(nodes, got["fits"], strict=True):
            assert [i for i in range(len(SELECTORS)) if bits >> i & 1] == [i for i, s in enumerate(SELECTORS) if any(fits(n, c) for c in _chains(s))]


@pytest.mark.parametrize("bad", ["", "a,", "a >", "a::before", "a:hover", "[", "a b >", "p:nth-child(x)", ".", "a$", "p:not()", "> a"])
def test_unknown_selectors_are_errors(bad):
    with pytest.raises(ValueError):
        Automaton((bad,))


def test_compound_parts():
    c = Compound("a#b.c.d[e]")
    assert (c.tag, c.id, c.classes, len(c.tests)) == ("a", "b", ["c", "d"], 1)


def test_parse_answers_selectors_and_texts(spark):
    page = '<html><body><div class="board"><ul><li class="card"><h3>T</h3> one <b>two</b></li><li>x</li></ul></div><p>a<time>soon</time>'
    pages = spark.createDataFrame([(1, page, [".card h3", "ul > li"]), (2, None, None), (3, "", ["p"])], "id int, html string, mine array<string>")
    parsed = dom.parsed(pages, ["id"], selectors=[".board li"], own="mine")
    fit = dom.fits(parsed)
    out = parsed.select("id", *[F.transform(dom.having(lambda e, s=s: fit(e, s)), lambda e: dom.text_of(e)).alias(n) for n, s in (("a", ".board li"), ("b", 0), ("c", F.lit(1)))], F.transform(dom.having(lambda e: e["tag"] == "time"), lambda e: dom.before(e)).alias("d"))
    rows = {r.id: r for r in out.collect()}
    assert (rows[1].a, rows[1].b, rows[1].c, rows[1].d) == (["T one two", "x"], ["T"], ["T one two", "x"], ["a"])
    assert rows[2].a == rows[3].b == []
    with pytest.raises(ValueError, match="without the selector"):
        fit(F.col("e"), "nav")
    with pytest.raises(ValueError):
        dom.parsed(pages, ["id"], selectors=["a:hover"])


def written(source, selector="", volatile=(), attributes=()):
    return dom.Written((selector,) if selector else (), tuple(volatile), tuple(attributes)).feed(source).result()


def test_content_is_the_scoped_part_less_what_changes():
    page = '<!doctype HTML>\n<body class="ad"><div id=c nonce=1><p nonce=2 a="x">t &amp; u<br>  <img src=i></p><!-- c --><ul><li class=ad>1<li>2<b class=new><i class=ad>3</i></b></ul></div><script>a<b</script>'
    assert written(page, "#c") == ('<div id="c" nonce="1"><p a="x">t &amp; u<br/> <img src="i"/></p><!-- c --><ul><li class="ad">1</li><li>2<b class="new"><i class="ad">3</i></b></li></ul></div>', True, ["@nonce"])
    assert written(page, "#c", [".ad", ".new"], ["src", "a"]) == ('<div id="c" nonce="1"><p>t &amp; u<br/> <img/></p><!-- c --><ul><li>2</li></ul></div>', True, [".ad", ".new", "@a", "@nonce", "@src"])
    assert written(page, "#c", [".new", ".ad"])[2] == [".ad", ".new", "@nonce"] and written(page, "#c", ["b", "i"])[2] == ["@nonce", "b"]
    text, scoped, removed = written(page, "main", ["#c"])
    assert (text, scoped, removed) == ('<!DOCTYPE HTML> <body class="ad"><script>a<b</script></body>', False, ["#c"])
    assert written("") == ("", False, []) and written("a<p>b<p>c", "p:nth-of-type(2)")[0] == "<p>c</p>"


def test_hashes_patterns_and_null_pages(spark):
    from pagewarden.operators import versions

    pages = spark.createDataFrame([(1, "<main>a 12 views</main>"), (2, "<main>a 13 views</main>"), (3, None), (4, "<p>b")], "id int, html string")
    rows = {r.id: r for r in versions.content_hashes(pages, ["id"], selector="main", patterns=[r"\d+ views", "(", "never"]).collect()}
    assert rows[1].content_hash == rows[2].content_hash and rows[1].removed == ["invalid-pattern:(", r"pattern:\d+ views"]
    assert rows[3].content_hash is None and rows[4].hash_scope == dom.FULL and rows[4].removed == ["invalid-pattern:("]
    same = versions.content_hashes(pages.where("id < 3"), ["id"], selector="main").select("content_hash").distinct()
    assert same.count() == 2


def test_changed_subtrees_against_a_walk_of_both_trees(spark):
    from pagewarden.operators import versions

    rng = random.Random(5)

    def page(seed):
        r = random.Random(seed)
        return "".join(r.choice(["<div>", "<p>", "</p>", "</div>", "<b>", "</b>", "x ", "y ", '<i class="k">', "</i>"]) for _ in range(40))

    rows = []
    for i in range(30):
        old = page(i)
        at = rng.randrange(len(old))
        rows.append((i, old, old if i % 5 == 0 else old[:at] + rng.choice(["z", "<u>new</u>", "<b>"]) + old[at:]))
    df = spark.createDataFrame(rows, "id int, a string, b string")
    found = versions.changed_subtrees(*[dom.parsed(df, ["id"], html_col=c, digests=True) for c in ("a", "b")], ["id"])
    got = sorted(((r.id, r.status, r.location) for r in found.collect()), key=repr)

    def walked(source):
        c = dom.elements_of(source, digests=True).columns
        return {p: (f"{t}[{n}]", u, o) for p, t, n, u, o in zip(c["place"], c["tag"], c["nth"], c["up"], c["own"], strict=True)}

    want = []
    for i, a, b in rows:
        x, y = walked(a), walked(b)
        want += [(i, "added", v[0]) for p, v in y.items() if p not in x and (v[1] in x or v[1] not in y)]
        want += [(i, "removed", v[0]) for p, v in x.items() if p not in y and (v[1] in y or v[1] not in x)]
        want += [(i, "changed", v[0]) for p, v in y.items() if p in x and x[p][2] != v[2]]
    assert got == sorted(want, key=repr) and any(s == "changed" for _, s, _ in got)
