"""HTML text as a stream of texts and tags, in one pass forward.

Whatever the text looks like, every character is looked at a bounded number of times: a
search that failed once (for the end of a tag, of a comment, of raw content) isn't
tried again further on.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: A tag: quotes count after an equals sign only, and one that isn't closed is a plain character.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
#: Elements whose content isn't markup in any view, and those whose content browsers don't show as markup.
SCRIPTS = frozenset(("script", "style"))
RAW = SCRIPTS | frozenset(("textarea", "title", "noscript", "template", "iframe", "xmp"))


def attributes(source: str) -> dict[str, str]:
    """Lower-cased names; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def scan(source: str, raw: frozenset[str] = RAW) -> Iterator[tuple[str, str, str]]:
    """("text", text as written, ""), ("open", tag, attributes as written), ("close", tag, ""), ("raw", tag, content), ("comment", content, ""), ("declaration", as written, "").

    A tag ends at the first ``>`` outside quoted values; if only quoted ones follow, quotes don't count from there on. A tag, comment or
    declaration that never ends is no text, and nothing follows it. Raw content without an end goes on to the end.
    """
    at = look = 0
    quotes, ends = True, {}
    while True:
        i = source.find("<", look)
        if i < 0:
            break
        m = (_TAG if quotes else _PLAIN_TAG).match(source, i)
        if m is None and quotes and source[i + 1 : i + 2].isascii() and source[i + 1 : i + 2].isalpha():
            quotes = False
            m = _PLAIN_TAG.match(source, i)
        if m is not None:
            if i > at:
                yield "text", source[at:i], ""
            at = look = m.end()
            tag = m[2].lower()
            if m[1]:
                yield "close", tag, ""
                continue
            yield "open", tag, m[3]
            if tag in raw and not m[3].endswith("/"):
                if tag not in ends:
                    ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I)
                e = ends[tag].search(source, at)
                stop = e.start() if e else len(source)
                if stop > at:
                    yield "raw", tag, source[at:stop]
                yield "close", tag, ""
                at = look = e.end() if e else len(source)
            continue
        mark = source[i + 1 : i + 2]
        if mark in ("!", "?", "/") or mark.isascii() and mark.isalpha():
            if i > at:
                yield "text", source[at:i], ""
            comment = source.startswith("<!--", i)
            stop = source.find("-->", i + 2) if comment else source.find(">", i)
            if stop < 0:
                return
            if comment:
                yield "comment", source[i + 4 : stop], ""
            elif mark in ("!", "?"):
                yield "declaration", source[i : stop + 1], ""
            at = look = stop + (3 if comment else 1)
            continue
        look = i + 1  # a sign of its own
    if at < len(source):
        yield "text", source[at:], ""
