"""A forgiving scan of HTML into text blocks with their place in the document."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Elements whose content is no markup; it runs to the element's end tag. Longer
#: names that begin with one (svg-icon) are other elements; <svg/> and <math/>
#: close themselves.
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes|template|svg|math"
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?:svg|math)(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<(?P<raw>{RAW})(?=[\s/>]|\Z)(?P<rattr>[^>]*)(?:>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)"
    r"|<[!?/](?:[^>]*)(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements that neither start nor end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img picture source nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold blocks; the innermost one is a block's parent.
HOLDERS = frozenset("html body head main article section nav aside header footer form div ul ol dl table menu dialog details figure blockquote fieldset center noscript button select".split())


@dataclass
class Holder:
    tag: str
    number: int
    words: frozenset = frozenset()
    role: str = ""
    hidden: bool = False
    above: Holder | None = None  # the holder around it
    in_head: bool = False

    def chain(self) -> Iterator[Holder]:
        """It and the holders around it, innermost first, without the page."""
        h = self
        while h.above is not None:
            yield h
            h = h.above


@dataclass
class Block:
    tag: str
    holder: Holder
    text: str
    linked: int  # characters inside links
    parts: list = field(default_factory=list)


def scan(source: str, links: list | None = None, head: dict | None = None) -> list[Block]:
    """Text blocks in page order. ``links`` collects href values, ``head`` the
    title and language. Scripts, styles and comments give no text; a page that
    breaks off inside a tag, comment or script loses only that piece."""
    root = Holder("", 0)
    stack: list[Holder] = [root]
    still: Counter = Counter()  # open holders by tag
    made, blocks = 0, []
    parts: list[str] = []
    linked, in_link, tag = 0, 0, ""

    def flush(next_tag):
        nonlocal parts, linked, tag
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(tag, stack[-1], text, linked))
            parts, linked = [], 0
        tag = next_tag

    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            piece = source[at:m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        raw = m["raw"]
        if raw:
            if head is not None and raw.lower() == "title" and "title" not in head:
                head["title"] = " ".join(html.unescape(m["body"] or "").split())
            continue
        name = m["tag"]
        if not name:
            continue
        name = name.lower()
        if m["close"]:
            if name == "a":
                in_link = 0
            if name in INLINE:
                continue
            if name in HOLDERS:
                flush("")
                if still[name]:
                    shut = ""
                    while shut != name:
                        shut = stack.pop().tag
                        still[shut] -= 1
                in_link = 0
            else:
                flush("")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = 1
            if links is not None:
                links.extend(v for k, v in attributes(m["attr"]) if k == "href")
        if name in INLINE:
            continue
        flush(name)
        in_link = 0
        if name == "html" and head is not None:
            head.update((k, v) for k, v in attributes(m["attr"]) if k == "lang")
        if name in HOLDERS and name not in VOID:
            made += 1
            stack.append(_holder(name, made, m["attr"], stack[-1]))
            still[name] += 1
    if at < len(source):
        parts.append(source[at:])
    flush("")
    return blocks


def attributes(attr: str) -> list[tuple[str, str]]:
    return [(k.lower(), html.unescape(a or b or c)) for k, a, b, c in ATTR.findall(attr)] if "=" in attr else []


def _holder(name, number, attr, above) -> Holder:
    words, role, hidden = set(), "", bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attr)) if attr else False
    for k, v in attributes(attr):
        if k in ("class", "id"):
            words.update(re.sub(r"([a-z])([A-Z])", r"\1-\2", v).lower().split())
        elif k == "role":
            role = v.lower()
        elif k == "style":
            hidden = hidden or "display:none" in v.replace(" ", "").lower()
        elif k == "aria-hidden":
            hidden = hidden or v.lower() == "true"
    return Holder(name, number, frozenset(words), role, hidden, above, above.in_head or name == "head")
