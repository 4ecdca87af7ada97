"""A scanner of markup that reads each character of a page a bounded number of times.

Browsers accept anything, so the scanner does too, but never looks for the end of a
tag further than it then goes on from: a tag ends at its `>`, or before a `<` outside
of quotes, and one with a quote that nothing closes ends at the first of either after
that quote. What begins like a tag where no `>` follows any more is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

NAME = re.compile(r"[a-zA-Z][^\s/><\"']*")
# What ends a stretch outside of quotes.
STOP = re.compile(r"[<>\"']")
EDGE = re.compile(r"[<>]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements whose text is no markup.
RAW = frozenset("script style title textarea iframe noscript template noembed noframes xmp".split())


class Token(NamedTuple):
    """Markup page[start:end]; `name` is empty for comments and declarations."""

    start: int
    end: int
    name: str
    closing: bool
    attributes: str


def tokens(page: str, raw: frozenset = RAW) -> Iterator[Token]:
    """All markup of a page in order; nothing between a raw element's tags counts."""
    last = {c: page.rfind(c) for c in "<>\"'"}
    at = 0
    while (start := page.find("<", at)) >= 0 and start < last[">"]:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            yield Token(start, end, "", False, "")
        elif page[start + 1] in "!?":
            end = page.find(">", start) + 1
            yield Token(start, end, "", False, "")
        else:
            closing = page[start + 1] == "/"
            name = NAME.match(page, start + 1 + closing)
            if not name:
                if closing:  # as a comment
                    end = page.find(">", start) + 1
                    yield Token(start, end, "", False, "")
                    at = end
                else:
                    at = start + 1
                continue
            stop, end = _tag_end(page, name.end(), last)
            tag = name[0].lower()
            yield Token(start, end, tag, closing, page[name.end() : stop])
            if tag in raw and not closing:
                end = raw_end(page, tag, end)
        at = end


def _tag_end(page: str, at: int, last: dict[str, int]) -> tuple[int, int]:
    """Where the attributes end and what follows the tag begins."""
    while found := STOP.search(page, at):
        mark, at = found[0], found.start()
        if mark == ">":
            return at, at + 1
        if mark == "<":
            return at, at
        if at >= last[mark]:  # nothing closes it
            edge = EDGE.search(page, at + 1)
            if edge is None:
                break
            return edge.start(), edge.end() if edge[0] == ">" else edge.start()
        at = page.find(mark, at + 1) + 1
    return len(page), len(page)


def raw_end(page: str, tag: str, at: int) -> int:
    """Where the closing tag of a raw element begins; the end of the page if there is none."""
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def attributes(text: str) -> dict[str, str]:
    """The first value of each attribute, by lower-cased name."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found
