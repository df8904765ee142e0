"""Main-text extraction by minimum cut.

Every text block of a page is a node. A hand-set linear classifier turns its
features (place in the page, link density, length) into two costs, which become
the capacities from the source (cost of calling it boilerplate) and to the sink
(cost of calling it content). Edges between neighbours in page order and
between neighbours with the same parent make it dear to part them. The minimum
cut is the cheapest labelling; blocks on the source side are the main text.
Neighbouring blocks with the same parent, kind and evidence for the same side
are one node whose capacities add up, so that a page's graph stays small.

Defined results: null or empty html gives an empty text; a null url or id is
kept; a page of any length is read whole; repeated rows each give a row; an
empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import lean
from tillsight.llm.html_blocks import Block, Holder, scan

BOILER_TAGS = frozenset("nav footer aside form menu dialog button select fieldset head noscript".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert sidebar side menu nav navbar navigation topnav breadcrumb breadcrumbs footer masthead comment comments "
    "disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login popup modal overlay widget toolbar pagination pager skip copyright legal".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
HEADER_WORDS = frozenset(("header",))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Classifier weights, in cost units. Full evidence of content outweighs a place.
BOILER_PLACE, CONTENT_PLACE, CONTENT_NAME, HEADING, LINKED, SHORT = 5.5, 3.0, 1.0, 1.0, 5.0, 1.0
WORDS_PER_UNIT, MOST_UNITS = 12.0, 4.0
#: Smoothness: neighbours in page order; the same parent besides.
ADJACENT, SAME_PARENT = 0.4, 1.2


#: A holder with more of the page's unlinked text than this is the page itself;
#: its names and a form around it say nothing about its blocks.
WHOLE_PAGE = 0.75


@lru_cache(1 << 16)
def listed(token: str) -> tuple[bool, bool, bool]:
    """Is a class or id a name of boilerplate, of content, of a header: as a
    whole, or with all its parts (cookie-banner, but not has-sidebar)."""
    parts = {x for x in re.split(r"[^a-z0-9]+", token) if x}
    return tuple(bool(parts) and parts <= names for names in (BOILER_WORDS, CONTENT_WORDS, HEADER_WORDS))


def whole_page(blocks: list[Block]) -> frozenset:
    """Numbers of the holders that hold most of the page's text."""
    held: Counter = Counter()
    holders: dict[int, Holder] = {}
    total = 0
    for b in blocks:
        own = max(len(b.text) - b.linked, 0)
        total += own
        held[b.holder.number] += own
        for h in b.holder.chain():
            if h.number in holders:
                break
            holders[h.number] = h
    for n in sorted(holders, reverse=True):  # a holder's number is above those around it
        held[holders[n].above.number] += held[n]
    return frozenset(n for n in holders if held[n] > WHOLE_PAGE * total)


def place(holder: Holder, page: frozenset = frozenset()) -> tuple[bool, float]:
    """Is the holder inside boilerplate, and the evidence of content from it.
    A header inside an article belongs to it. Evidence from outside a piece of
    boilerplate doesn't hold inside it: comments below an article's text stand
    in the article, too."""
    known, todo = (False, False, False, False), []
    for h in holder.chain():
        if hasattr(h, "state"):
            known = h.state
            break
        todo.append(h)
    for h in reversed(todo):  # from the outside in; each holder is asked once a page
        known = h.state = _inside(h, known, page)
    boiler, inside, named, _ = known
    return boiler, CONTENT_PLACE * inside + CONTENT_NAME * named


def _inside(h: Holder, around: tuple, page: frozenset) -> tuple[bool, bool, bool, bool]:
    """(boilerplate, in an article, with a name of content, has an article
    around it anywhere) of a holder, from those of the holder around it."""
    boiler, inside, named, article = around
    names = [listed(x) for x in h.words]
    page_wide = h.number in page or h.tag in ("html", "body")
    by_name = not page_wide and (h.tag == "form" or any(x[0] for x in names))
    by_header = not article and (h.tag == "header" or not page_wide and any(x[2] for x in names))
    by_role = h.role in BOILER_ROLES and not (page_wide and h.role == "form")
    if h.hidden or h.tag in BOILER_TAGS and h.tag != "form" or by_role or by_name or by_header:
        return True, False, False, article
    if h.tag in CONTENT_TAGS or h.role in ("main", "article"):
        inside = article = True
    return boiler, inside, named or any(x[1] for x in names), article


def costs(block: Block, page: frozenset = frozenset()) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content)."""
    boiler, content = place(block.holder, page)
    n = block.text.count(" ") + 1
    density = min(1.0, block.linked / max(len(block.text), 1))
    keep = content + min(n / WORDS_PER_UNIT, MOST_UNITS) * (1 - density) + HEADING * (block.tag in HEADINGS and content > 0)
    drop = BOILER_PLACE * boiler + LINKED * density + SHORT * (n < 4)
    return keep, drop


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (the largest
    one). Blocking flows over shortest paths, after the flow that runs straight
    through each node."""
    n = len(source)
    s, t = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i in range(n):
        through = min(source[i], sink[i])
        if source[i] > through:
            cap[s][i], cap[i][s] = source[i] - through, 0.0
        if sink[i] > through:
            cap[i][t], cap[t][i] = sink[i] - through, 0.0
    for a, b, w in edges:
        cap[a][b] = cap[a].get(b, 0.0) + w
        cap[b][a] = cap[b].get(a, 0.0) + w
    to = [list(c) for c in cap]
    while True:  # a layer of shortest paths at a time
        depth = [-1] * (n + 2)
        depth[s] = 0
        todo = deque((s,))
        while todo and depth[t] < 0:
            x = todo.popleft()
            for y, c in cap[x].items():
                if c > 1e-12 and depth[y] < 0:
                    depth[y] = depth[x] + 1
                    todo.append(y)
        if depth[t] < 0:
            break
        arc, path = [0] * (n + 2), [s]
        while path:
            x = path[-1]
            if x == t:
                flow = min(cap[a][b] for a, b in pairwise(path))
                for a, b in pairwise(path):
                    cap[a][b] -= flow
                    cap[b][a] += flow
                full = next(i for i, (a, b) in enumerate(pairwise(path)) if cap[a][b] <= 1e-12)
                del path[full + 1:]
                continue
            while arc[x] < len(to[x]):
                y = to[x][arc[x]]
                if cap[x][y] > 1e-12 and depth[y] == depth[x] + 1:
                    path.append(y)
                    break
                arc[x] += 1
            else:
                path.pop()
                if path:
                    arc[path[-1]] += 1
    # the largest source side: what can't reach the sink
    reach = {t}
    todo = deque((t,))
    while todo:
        y = todo.popleft()
        for x in cap[y]:
            if cap[x].get(y, 0.0) > 1e-12 and x not in reach:
                reach.add(x)
                todo.append(x)
    return [i not in reach for i in range(n)]


def label(blocks: list[Block]) -> list[bool]:
    """True for each content block."""
    nodes: list[list] = []  # source, sink, parent, kind, first block, last block
    of: list[int] = []
    page = whole_page(blocks)
    for b in blocks:
        keep, drop = costs(b, page)
        kind = (b.holder.number, b.tag in HEADINGS, keep > drop)
        if nodes and nodes[-1][2] == kind:
            nodes[-1][0] += keep
            nodes[-1][1] += drop
        else:
            nodes.append([keep, drop, kind])
        of.append(len(nodes) - 1)
    edges, last = [], {}
    for i, (_, _, kind) in enumerate(nodes):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if kind[0] in last:
            edges.append((last[kind[0]], i, SAME_PARENT))
        last[kind[0]] = i
    side = min_cut([n[0] for n in nodes], [n[1] for n in nodes], edges)
    return [side[i] for i in of]


def main_text(source: str | None) -> str:
    blocks = scan(source or "")
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in lean(batches):
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op9_html_min_cut(spark, sf_dir):
    """Contract query: main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
