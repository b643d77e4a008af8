"""HTML as elements, parsed once for all rules that need structure.

A page is one row with an array of slim elements and one of its texts in order; rules filter and
transform the elements by column expressions, so that a plan parses each page once and moves no
text. An element has its place (seq, the last seq inside it as end, its parent, its number among those of
its tag), tag, attributes, own text, and where its texts begin and end in the page's texts: a page has each
text once however deep it is nested, and text_of() puts together what an element holds when a rule asks for it.

Selectors that rules need are compiled before the parse (sources/selectors.py); an element carries a bit
for each that it fits. With digests, an element also carries its place in the tree, a digest of its
own tag, attributes and texts, and one of all that it holds, so that equal subtrees are found without reading them again.

The parse takes time in proportion to the page: a tag is pushed and popped once, a closing tag without
an open one is known by a count, and of the elements around only masks are kept.
"""

from __future__ import annotations

import html
from bisect import bisect_right
from collections.abc import Iterable
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.sources.markup import SCRIPTS, attributes, scan
from pagewarden.sources.selectors import Automaton, compiled

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second kinds.
ENDS = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Selectors that this library's rules use; every parse answers them.
RULES = ("label *", "thead th", "table tbody tr", "nav a, header a")
FIELDS = (
    ("seq", pa.int32(), "int"), ("parent", pa.int32(), "int"), ("end", pa.int32(), "int"), ("nth", pa.int32(), "int"), ("tag", pa.string(), "string"), ("attrs", pa.map_(pa.string(), pa.string()), "map<string,string>"), ("own_text", pa.string(), "string"),
    ("text_start", pa.int32(), "int"), ("text_end", pa.int32(), "int"), ("before_start", pa.int32(), "int"), ("before_end", pa.int32(), "int"), ("fits", pa.int64(), "bigint"),
)
DIGESTS = (("place", pa.int64(), "bigint"), ("up", pa.int64(), "bigint"), ("own", pa.int64(), "bigint"), ("digest", pa.int64(), "bigint"))
PAGES_AT_ONCE = 50
MOST_SELECTORS = 63
#: Attributes that change at each load, whatever the page (fixed values).
VOLATILE = frozenset(("nonce", "data-nonce"))


def _words(parts) -> str:
    return " ".join(" ".join(parts).split())


def hashed(*parts: str) -> int:
    """64 bits of a digest of the parts, signed."""
    h = blake2b(digest_size=8)
    for p in parts:
        data = p.encode("utf-8", "surrogatepass")
        h.update(len(data).to_bytes(8, "little"))
        h.update(data)
    return int.from_bytes(h.digest(), "little", signed=True)


class Open:
    """An element while it is open, with what its children need to know."""

    __slots__ = ("seq", "tag", "attrs", "classes", "depth", "child", "of_type", "bits", "around", "last", "older", "children", "kinds", "own", "first_text", "node1", "node2", "node3", "place", "whole", "shape")

    def __init__(self, seq, tag, attrs, depth, child, of_type):
        self.seq, self.tag, self.attrs, self.depth, self.child, self.of_type = seq, tag, attrs, depth, child, of_type
        self.classes = attrs["class"].split() if "class" in attrs else ()
        self.bits = self.around = self.last = self.older = self.children = 0
        self.kinds: dict[str, int] | None = None
        self.own: list[str] | None = None
        self.first_text = 0
        self.node1 = self.node2 = self.node3 = -1  # where the texts of the last three nodes in it begin, the oldest first


class Tree:
    """Elements of a page as columns, in order, and its texts."""

    def __init__(self, automaton: Automaton, digests: bool = False, leave_out: frozenset[str] = VOLATILE):
        self.automaton, self.digests, self.leave_out = automaton, digests, leave_out
        self.columns: dict[str, list] = {name: [] for name, *_ in (*FIELDS, *(DIGESTS if digests else ()))}
        self.texts: list[str] = []
        self.count: dict[str, int] = {}
        self.open_tags: dict[str, int] = {}
        root = Open(-1, "", {}, -1, 0, 0)
        if digests:
            root.place, root.whole, root.shape = hashed("page"), blake2b(digest_size=8), blake2b(digest_size=8)
        self.stack = [root]

    def feed(self, source: str) -> Tree:
        for kind, a, b in scan(source, SCRIPTS):
            if kind == "text":
                self.data(html.unescape(a) if "&" in a else a)
            elif kind == "raw":
                self.data(b)
            elif kind == "open":
                self.start(a, b)
            elif kind == "close":
                self.stop(a)
        while len(self.stack) > 1:
            self.finish(self.stack.pop())
        return self

    def start(self, tag: str, written: str) -> None:
        stack, columns = self.stack, self.columns
        self.implied(tag)
        up, seq = stack[-1], len(columns["seq"])
        attrs = attributes(written) if written and not written.isspace() else {}
        up.children += 1
        if up.kinds is None:
            up.kinds = {}
        up.kinds[tag] = of_type = up.kinds.get(tag, 0) + 1
        e = Open(seq, tag, attrs, len(stack) - 1, up.children, of_type)
        e.around = up.around | up.bits
        e.bits = self.automaton.step(e, e.around, up.bits, up.last, up.older)
        up.last, up.older = e.bits, up.older | e.bits
        e.first_text = len(self.texts)
        nth = self.count.get(tag, 0)
        self.count[tag] = nth + 1
        # What a time stands behind: the three nodes before it.
        before = next((n for n in (up.node1, up.node2, up.node3) if n >= 0), e.first_text) if tag == "time" else e.first_text
        fits = self.automaton.matches(e.bits)
        for name, value in (("seq", seq), ("parent", up.seq), ("end", seq), ("nth", nth), ("tag", tag), ("attrs", list(attrs.items())), ("own_text", ""), ("text_start", e.first_text), ("text_end", 0), ("before_start", before), ("before_end", e.first_text), ("fits", fits)):
            columns[name].append(value)
        if self.digests:
            e.place = hashed(str(up.place), tag, str(of_type))
            e.whole, e.shape = blake2b(digest_size=8), blake2b(digest_size=8)
            kept = [x for k in sorted(attrs) if k not in self.leave_out for x in (k, attrs[k])]
            head = hashed(tag, *kept).to_bytes(8, "little", signed=True)
            e.whole.update(head)
            e.shape.update(head)
            for name, value in (("place", e.place), ("up", up.place), ("own", 0), ("digest", 0)):
                columns[name].append(value)
        if tag in VOID or written.endswith("/"):
            self.finish(e)
        else:
            stack.append(e)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def implied(self, tag: str) -> None:
        """Closes what a start tag ends."""
        for old in ENDS.get(tag, ()):
            if self.stack[-1].tag == old:
                self.finish(self.stack.pop())

    def data(self, text: str) -> None:
        words = " ".join(text.split())
        up = self.stack[-1]
        up.node1, up.node2, up.node3 = up.node2, up.node3, len(self.texts)
        if words:
            self.texts.append(words)
            if up.own is None:
                up.own = []
            up.own.append(words)
            if self.digests:
                mark = b"\1" + hashed(words).to_bytes(8, "little", signed=True)
                up.whole.update(mark)
                up.shape.update(mark)

    def stop(self, tag: str) -> None:
        if not self.open_tags.get(tag):
            return
        while True:
            e = self.stack.pop()
            self.finish(e)
            if e.tag == tag:
                return

    def finish(self, e: Open) -> None:
        columns, up = self.columns, self.stack[-1]
        if e.tag not in VOID and self.open_tags.get(e.tag):
            self.open_tags[e.tag] -= 1
        columns["end"][e.seq] = len(columns["seq"]) - 1
        columns["text_end"][e.seq] = len(self.texts)
        if e.own is not None:
            columns["own_text"][e.seq] = " ".join(e.own)
        up.node1, up.node2, up.node3 = up.node2, up.node3, e.first_text
        if self.digests:
            columns["own"][e.seq] = int.from_bytes(e.shape.digest(), "little", signed=True)
            columns["digest"][e.seq] = int.from_bytes(e.whole.digest(), "little", signed=True)
            up.whole.update(b"\2" + e.whole.digest())
            up.shape.update(b"\2")


def elements_of(source: str | None, selectors: tuple[str, ...] = RULES, digests: bool = False, leave_out: frozenset[str] = VOLATILE) -> Tree:
    return Tree(compiled(tuple(selectors)), digests, leave_out).feed(source or "")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a few large splits dealt out to all cores; what has a split for each fourth core or more isn't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    return df.repartition(cores) if n * 4 <= cores or n < min(cores, 8) else df


def parsed(pages: DataFrame, keys: Iterable[str], *, html_col: str = "html", selectors: Iterable[str] = (), own: str | None = None, digests: bool = False, leave_out: Iterable[str] = ()) -> DataFrame:
    """The pages' keys, the array of their elements, and that of their texts. Null or empty HTML has none.

    selectors: those that rules will ask for by fits() besides RULES. own: a column of further selectors of each page (an array of strings), which
    fits() knows by their place. digests: elements carry place, up, own and digest; leave_out: attributes that don't count for these.
    """
    keys, base = list(keys), tuple(dict.fromkeys([*RULES, *selectors]))
    compiled(base)  # an unknown one is an error here
    if len(base) > MOST_SELECTORS:
        raise ValueError("too many selectors for one parse")
    extra = [F.col(own).alias("\x01own")] if own else []
    rows = dealt(pages.select(*keys, F.col(html_col).cast("string").alias("\x01html"), *extra))
    fields, without = (*FIELDS, *(DIGESTS if digests else ())), VOLATILE | frozenset(leave_out)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(a, PAGES_AT_ONCE)
                more = part.column(len(keys) + 1).to_pylist() if own else [()] * part.num_rows
                trees = [elements_of(h.as_py(), (*base, *(m or ())), digests, without) for h, m in zip(part.column(len(keys)), more, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], _listed(trees, fields), pa.array([t.texts for t in trees], pa.list_(pa.string()))], names=[*keys, "elements", "texts"])

    ddl = ", ".join(f"{name}: {kind}" for name, _, kind in fields)
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), f"elements array<struct<{ddl}>>, texts array<string>"])
    return rows.mapInArrow(run, schema).withMetadata("elements", {"selectors": list(base)})


def _listed(trees: list[Tree], fields) -> pa.Array:
    offsets = [0]
    for t in trees:
        offsets.append(offsets[-1] + len(t.columns["seq"]))
    arrays = [pa.array([v for t in trees for v in t.columns[name]], kind) for name, kind, _ in fields]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names=[name for name, *_ in fields]))


class Written(Tree):
    """A page written out again, element by element: the part that a selector scopes, without what changes at each load."""

    def __init__(self, content: tuple[str, ...], volatile: tuple[str, ...], attributes_: tuple[str, ...]):
        super().__init__(compiled((*content, *volatile)))
        self.content, self.volatile, self.attributes = len(content), volatile, attributes_
        self.out: list[str] = []
        self.root: list[int] | None = None  # where its pieces begin and end
        self.root_tag = ""
        self.cuts: list[list[int]] = []  # begin, end, number of the selector
        self.names: list[tuple[int, str]] = []  # place and name of attributes that were left out
        self.begun: dict[int, tuple[int, list]] = {}

    def feed(self, source: str) -> Written:
        escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        for kind, a, b in scan(source, SCRIPTS):
            if kind == "text":
                self.out.append(escape(html.unescape(a)))
            elif kind == "raw":
                self.out.append(b)
            elif kind == "open":
                self.start(a, b)
            elif kind == "close":
                self.stop(a)
            elif kind == "comment":
                self.out.append(f"<!--{a}-->")
            elif a[:9].lower() == "<!doctype":
                self.out.append(f"<!DOCTYPE{a[9:]}\n")
            else:
                self.out.append(a)
        while len(self.stack) > 1:
            self.finish(self.stack.pop())
        return self

    def start(self, tag: str, written: str) -> None:
        self.implied(tag)
        at, before = len(self.out), len(self.columns["seq"])
        self.out.append("")
        super().start(tag, written)
        fits, attrs = self.columns["fits"][before], self.columns["attrs"][before]
        quoted = lambda v: "'" + v + "'" if '"' in v and "'" not in v else '"' + v.replace('"', "&quot;") + '"'
        text = lambda held: "<" + tag + "".join(f" {k}={quoted(v.replace('&', '&amp;').replace('<', '&lt;').replace('>', '&gt;'))}" for k, v in held) + ("/>" if tag in VOID else ">")
        self.out[at] = text([(k, v) for k, v in attrs if k not in VOLATILE and k not in self.attributes])
        self.names += [(at, k) for k, _ in attrs if k in VOLATILE or k in self.attributes]
        if self.content and fits & 1 and self.root is None:
            self.root, self.root_tag = [at, len(self.out), before], text(attrs)
        for i in range(len(self.volatile)):
            if fits >> (self.content + i) & 1:
                cut = [at, len(self.out), i]
                self.cuts.append(cut)
                self.begun.setdefault(before, []).append(cut)

    def finish(self, e: Open) -> None:
        super().finish(e)
        if e.tag not in VOID:
            self.out.append(f"</{e.tag}>")
        for cut in self.begun.pop(e.seq, ()):
            cut[1] = len(self.out)
        if self.root is not None and self.root[2] == e.seq:
            self.root[1] = len(self.out)

    def result(self) -> tuple[str, bool, list[str]]:
        """The text with white space as single blanks, whether it is the selector's part, and what was left out."""
        begin, end, _ = self.root or (-1, len(self.out), 0)
        inside = [c for c in self.cuts if c[0] > begin and c[1] <= end]
        gone: list[tuple[int, int]] = []  # apart from each other, in order
        removed = set()
        for i, selector in enumerate(self.volatile):
            starts = [a for a, _ in gone]
            for a, b, k in inside:
                if k == i:
                    at = bisect_right(starts, a) - 1
                    if at < 0 or gone[at][1] < b:
                        removed.add(selector)
            gone = _united(gone + [(a, b) for a, b, k in inside if k == i])
        starts = [a for a, _ in gone]
        kept = lambda at: begin < at < end and not ((j := bisect_right(starts, at) - 1) >= 0 and at < gone[j][1])
        removed |= {"@" + name for at, name in self.names if kept(at)}
        out = self.out
        pieces, at = ([self.root_tag], begin + 1) if self.root else ([], 0)
        for a, b in gone:
            pieces += out[at:a]
            at = b
        return " ".join("".join([*pieces, *out[at:end]]).split()), self.root is not None, sorted(removed)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FULL = "full_html_fallback"


def content(pages: DataFrame, keys: Iterable[str], *, html_col: str = "html", selector: str = "", volatile_selectors: Iterable[str] = (), volatile_attributes: Iterable[str] = ()) -> DataFrame:
    """(keys, content, scope, removed) of each page: the first element that fits the selector, or else the whole page (scope FULL), written out without elements and attributes that change at each load.

    removed names the selectors and (with @) attributes of what was left out. Null HTML has no content.
    """
    keys, first_of, out_of, names = list(keys), (selector,) if selector.strip() else (), tuple(volatile_selectors), tuple(volatile_attributes)
    compiled((*first_of, *out_of))
    if len(out_of) >= MOST_SELECTORS:
        raise ValueError("too many selectors for one parse")
    rows = dealt(pages.select(*keys, F.col(html_col).cast("string").alias("\x01html")))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(a, PAGES_AT_ONCE)
                found = [(None, False, []) if h is None else Written(first_of, out_of, names).feed(h).result() for h in part.column(len(keys)).to_pylist()]
                more = [pa.array([f[0] for f in found], pa.string()), pa.array([selector if f[1] else FULL for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *more], names=[*keys, "content", "scope", "removed"])

    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "content string, scope string, removed array<string>"])
    return rows.mapInArrow(run, schema)


def elements(pages: DataFrame, keys: Iterable[str], **settings) -> DataFrame:
    """A row for each element of each page, with the page's keys."""
    keys = list(keys)
    return parsed(pages, keys, **settings).select(*keys, F.explode("elements").alias("e")).select(*keys, "e.*")


def fits(pages: DataFrame):
    """Of parsed pages: a function that says whether an element fits a selector of the parse, or (given a number or a column) the page's own selector of that place."""
    known = pages.schema["elements"].metadata.get("selectors", [])

    def test(e: Column, selector: str | int | Column) -> Column:
        if isinstance(selector, str):
            if selector not in known:
                raise ValueError(f"the pages were parsed without the selector {selector!r}")
            return e["fits"].bitwiseAND(F.lit(1 << known.index(selector))) != 0
        place = F.lit(selector) if isinstance(selector, int) else selector
        return F.coalesce(F.getbit(e["fits"], place + len(known)) == 1, F.lit(False))

    return test


def text_of(e: Column, texts: Column | str = "texts") -> Column:
    """All text in an element, its pieces joined by blanks; null for no element."""
    return _between(e, "text", F.col(texts) if isinstance(texts, str) else texts)


def before(e: Column, texts: Column | str = "texts") -> Column:
    """The text of the three nodes before a time."""
    return _between(e, "before", F.col(texts) if isinstance(texts, str) else texts)


def _between(e: Column, what: str, texts: Column) -> Column:
    a, b = e[f"{what}_start"], e[f"{what}_end"]
    return F.array_join(F.slice(texts, a + 1, b - a), " ")


def having(when, array: Column | str = "elements") -> Column:
    """The elements of an array for which when(element) holds."""
    return F.filter(F.col(array) if isinstance(array, str) else array, lambda e: F.coalesce(when(e), F.lit(False)))


def attribute(e: Column, name: str) -> Column:
    return e["attrs"][name]


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def let(value: Column, body) -> Column:
    """body(value) with value computed once: within a filter or transform a column would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def inside(e: Column, outer: Column) -> Column:
    """Whether an element is inside another."""
    return (e["seq"] > outer["seq"]) & (e["seq"] <= outer["end"])


def has_class(e: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attribute(e, "class"), F.lit("")), r"\s+"), name)


def places(e: Column) -> Column:
    return F.concat(e["tag"], F.lit("["), e["nth"].cast("string"), F.lit("]"))
