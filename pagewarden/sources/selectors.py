"""CSS selectors as automata over the tags of a page.

All selectors of a parse are laid out in one row of bits, a bit for each compound of each
chain. An element's bits say which chains have come as far as that compound with the
element as its last: a compound fits by tag, id, class, attribute or place among its siblings,
and the bit before it is set in the parent (``>``), in any element around (blank), in the element
before (``+``) or in any sibling before (``~``). The parser keeps these four masks on its stack, so
that an element takes a few operations on integers, whatever its depth.

Known: tags, ``*``, ``#id``, ``.class``, ``[attr]`` with ``= ~= |= ^= $= *=``, ``:first-child``, ``:nth-child(an+b)``,
``:nth-of-type(an+b)``, ``:first-of-type``, ``:root``, ``:not(compound)``, lists by commas, and the four combinators. Others raise ValueError.
"""

from __future__ import annotations

import re
from functools import lru_cache

_NAME = r"(?:[\w\-]|\\.)+"
_PART = re.compile(rf"""\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>[\w:.\-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<q1>[^"]*)"|'(?P<q2>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]|:(?P<pseudo>[a-z\-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?|(?P<tag>\*|{_NAME})""")
_STEP = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*\Z")


def _nth(text: str):
    m = _NTH.match(text.lower())
    if m is None:
        raise ValueError(f"not a place among siblings: {text!r}")
    if m["word"]:
        a, b = 2, int(m["word"] == "odd")
    elif m["only"]:
        a, b = 0, int(m["only"])
    else:
        a = int(m["a"] + "1") if m["a"] in ("", "+", "-") else int(m["a"])
        b = int((m["sign"] or "+") + (m["b"] or "0"))
    return lambda i: (i - b) % a == 0 and (i - b) // a >= 0 if a else i == b


def _attribute(name: str, op: str | None, value: str | None):
    def test(e) -> bool:
        held = e.attrs.get(name)
        if held is None or op is None:
            return held is not None
        if op == "=":
            return held == value
        if op == "~=":
            return bool(value) and value in held.split()
        if op == "|=":
            return held == value or held.startswith(value + "-")
        if not value:
            return False
        return held.startswith(value) if op == "^=" else held.endswith(value) if op == "$=" else value in held

    return test


class Compound:
    """What one element must be: a tag or any, an id, classes, and tests."""

    def __init__(self, text: str):
        self.tag, self.id, self.classes, self.tests = None, None, [], []
        plain = lambda s: re.sub(r"\\(.)", r"\1", s)
        at = 0
        for m in iter(lambda: _PART.match(text, at), None):
            if m["tag"]:
                if at:
                    raise ValueError(f"a tag must come first: {text!r}")
                self.tag = None if m["tag"] == "*" else plain(m["tag"]).lower()
            elif m["id"]:
                if self.id is not None and self.id != plain(m["id"]):
                    self.tests.append(lambda e: False)
                self.id = plain(m["id"])
            elif m["cls"]:
                self.classes.append(plain(m["cls"]))
            elif m["attr"]:
                self.tests.append(_attribute(m["attr"].lower(), m["op"], next((v for v in (m["q1"], m["q2"], m["bare"]) if v is not None), None)))
            else:
                self.tests.append(self._pseudo(m["pseudo"], m["arg"]))
            at = m.end()
        if not at or at < len(text):
            raise ValueError(f"unknown selector: {text!r}")

    @staticmethod
    def _pseudo(name: str, arg: str | None):
        if name == "not" and arg:
            inner = Compound(arg.strip())
            return lambda e: not inner.fits(e)
        if name in ("first-child", "first-of-type") and arg is None:
            name, arg = "nth" + name[5:], "1"
        if name == "root" and arg is None:
            return lambda e: e.depth == 0
        if name in ("nth-child", "nth-of-type") and arg is not None:
            test = _nth(arg)
            return (lambda e: test(e.child)) if name == "nth-child" else (lambda e: test(e.of_type))
        raise ValueError(f"unknown pseudo-class: {name}")

    def fits(self, e) -> bool:
        return (self.tag is None or self.tag == e.tag) and (self.id is None or self.id == e.attrs.get("id")) and all(c in e.classes for c in self.classes) and all(t(e) for t in self.tests)


def _chains(selector: str) -> list[list[tuple[str, Compound]]]:
    """Of each part between commas its (combinator before, compound) in order."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(selector):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            parts.append(selector[start:i])
            start = i + 1
    out = []
    for part in (p.strip() for p in [*parts, selector[start:]]):
        if not part:
            raise ValueError(f"an empty part in {selector!r}")
        at, sign, chain = 0, "", []
        while at < len(part):
            end = at
            while end < len(part) and (m := _PART.match(part, end)):
                end = m.end()
            if end == at:
                raise ValueError(f"unknown selector: {part!r}")
            chain.append((sign, Compound(part[at:end])))
            if end == len(part):
                break
            m = _STEP.match(part, end)
            if m is None or m.end() == len(part):
                raise ValueError(f"unknown selector: {part!r}")
            sign, at = m[1] or " ", m.end()
        out.append(chain)
    return out


class Automaton:
    """Bits of all compounds of a list of selectors."""

    def __init__(self, selectors: tuple[str, ...]):
        self.first = self.around = self.parent = self.before = self.older = 0
        self.tags: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.named: dict[str, int] = {}  # by the first class
        self.any_tag = self.any_id = self.any_class = 0
        self.tested: list[tuple[int, Compound]] = []
        self.tested_mask = 0
        self.final: list[tuple[int, int]] = []  # mask of the last compounds of selector number i
        bit = 1
        for i, selector in enumerate(selectors):
            last = 0
            for chain in _chains(selector):
                for sign, c in chain:
                    kind = {"": "first", " ": "around", ">": "parent", "+": "before", "~": "older"}[sign]
                    setattr(self, kind, getattr(self, kind) | bit)
                    if c.tag is None:
                        self.any_tag |= bit
                    else:
                        self.tags[c.tag] = self.tags.get(c.tag, 0) | bit
                    if c.id is None:
                        self.any_id |= bit
                    else:
                        self.ids[c.id] = self.ids.get(c.id, 0) | bit
                    if not c.classes:
                        self.any_class |= bit
                    else:
                        self.named[c.classes[0]] = self.named.get(c.classes[0], 0) | bit
                    if len(c.classes) > 1 or c.tests:
                        self.tested.append((bit, c))
                        self.tested_mask |= bit
                    bit <<= 1
                last |= bit >> 1
            self.final.append((last, 1 << i))
        self.finals = sum(m for m, _ in self.final)

    def step(self, e, around: int, parent: int, before: int, older: int) -> int:
        """Bits of an element, from those of the elements around it (all together), its parent, the sibling before it, and all before it."""
        fits = self.first | around << 1 & self.around | parent << 1 & self.parent | before << 1 & self.before | older << 1 & self.older
        fits &= self.tags.get(e.tag, 0) | self.any_tag
        if not fits:
            return 0
        own = e.attrs.get("id")
        fits &= self.any_id | (self.ids.get(own, 0) if own is not None else 0)
        some = self.any_class
        if self.named:
            for c in e.classes:
                some |= self.named.get(c, 0)
        fits &= some
        if fits & self.tested_mask:
            for bit, c in self.tested:
                if fits & bit and not c.fits(e):
                    fits ^= bit
        return fits

    def matches(self, bits: int) -> int:
        """A bit for each selector that an element fits."""
        if not bits & self.finals:
            return 0
        out = 0
        for last, one in self.final:
            if bits & last:
                out |= one
        return out


@lru_cache(256)
def compiled(selectors: tuple[str, ...]) -> Automaton:
    return Automaton(selectors)
