"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks: the text between two block-level tags. A small classifier looks at a block's
tag, its ancestors, the words of their class and id, its share of link text and its length, and gives
the cost of calling it content or boilerplate; these costs are the capacities from the source and to
the sink. Neighbours in page order, and neighbours under one parent element, are joined by smoothness
edges. The minimum cut separates content from boilerplate with the least total cost. Before the flow
runs, blocks whose own cost outweighs all their edges are fixed, which never changes the cut's value.

Character references are decoded, white space in a block becomes one space, and content blocks are
joined in page order by one line end. Nothing else is dropped or shortened.

Results in special cases: null or empty html, or a page without content, gives an empty text; broken
and cut markup is read as far as it goes (an unfinished tag at the end is markup); repeated rows give
the same text; an empty table gives an empty table. Columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from wayloom.llm.arrow import column, with_columns

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br svg path input".split()
)
_SKIPPED = frozenset("script style noscript template iframe object head title select textarea svg math canvas audio video".split())
#: What may stand in a head; anything else ends it.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
_RAW = frozenset("script style textarea title iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words of class and id that speak for boilerplate, in fixed groups.
_BOILER = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promotions "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip "
    "header masthead topbar footer foot copyright legal sidebar aside side rail widget widgets "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast "
    "share sharing social related recommended recommendations trending popular newsletter subscribe subscription signup "
    "login form search comment comments commentlist reply replies respond disqus discussion tags tagcloud".split()
)
#: And those that speak for content.
_CONTENT = frozenset("article content main post story entry body text page".split())
#: Boilerplate words that within a longer name often tell how a page is laid out (``sidebar-left``).
_LAYOUT = frozenset("nav navbar navigation menu menus toc banner header masthead topbar footer foot sidebar aside side rail".split())
#: Words after these tell what else stands in an element (``page-with-sidebar``), not what it is.
_HOLDS = frozenset("has have with no without".split())
_AWAY = frozenset("nav aside menu dialog button fieldset".split())
_NEAR, _SIBLING = 1.0, 1.0


class Block(NamedTuple):
    text: str
    parent: int  # number of the element around the one that holds it
    score: float  # above 0: content
    linked: int  # characters within links


class _Open(NamedTuple):
    tag: str
    number: int
    context: float  # what the element and its ancestors say
    in_article: bool
    skip: bool
    parent: int = 0
    closed: bool = False  # an article within is none of the page's


def _said(tag: str, attributes: str, above: _Open) -> tuple[float, bool, bool, bool]:
    """Context, whether within an article, whether the element's text is never shown, and whether articles
    within it (comments, asides, link lists) are boilerplate."""
    context, in_article, closed = above.context, above.in_article, above.closed
    skip = above.skip or tag in _SKIPPED
    if tag in ("article", "main"):
        # A form or a wrapper named after its sidebar may be put around a whole page, so that an article
        # within it is still one.
        return context if closed else max(context, 6.0), True, skip, closed
    if tag == "form":
        context = min(context, -9.0)
    elif tag in _AWAY or tag == "footer" or tag == "header" and not in_article:
        context, closed = min(context, -12.0), True
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                skip = True
            elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"):
                context, closed = min(context, -12.0), True
            elif name in ("class", "id"):
                names = [_own_words(x) for x in value.split()]
                said = {w for x in names for w in x}
                if said & _BOILER and not (said & _BOILER == {"header"} and said & _CONTENT):
                    context = min(context, -12.0)
                    closed = closed or bool(said & _BOILER - _LAYOUT) or any(len(x) == 1 and x[0] in _BOILER for x in names)
                elif said & _CONTENT and context > -8:
                    context = max(context, 3.0)
    return context, in_article, skip, closed


def _own_words(name: str) -> list[str]:
    """Words of a class or id that tell what the element itself is."""
    out = _WORD.findall(_CAMEL.sub(" ", name).lower())
    return out[: next((k for k, w in enumerate(out) if w in _HOLDS), len(out))]


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order."""
    root = _Open("", 0, 0.0, False, False)
    stack = [root]
    out: list[Block] = []
    parts: list[str] = []
    linked, number, anchors = 0, 0, 0
    held = root  # the element in which the current block began

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append(Block(text, held.parent, _score(text, linked, held), linked))
        parts.clear()
        linked = 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        raw = m.group()
        tag = m.group(2) or m.group(6)
        if raw[0] != "<" or raw == "<":
            if stack[-1].tag == "head" and not raw.isspace():
                stack.pop()
            if not stack[-1].skip:
                if not parts:
                    held = next(e for e in reversed(stack) if e.tag not in _INLINE)
                text = unescape(raw)
                parts.append(text)
                if anchors:
                    linked += len(text.strip())
            continue
        if tag is None:
            continue  # comment, doctype or processing instruction
        tag = tag.lower()
        closing = m.group(1) or m.group(5)
        attributes = m.group(3) if m.group(2) else m.group(7)
        if not closing and (stack[-1].tag == "head" and tag not in _IN_HEAD or tag == "body"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "head":
                    del stack[k:]
                    break
        if tag not in _INLINE:
            end()
        elif tag == "br":
            parts.append(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    anchors -= sum(e.tag == "a" for e in stack[k:])
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break  # an inline end tag doesn't end blocks
            continue
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            # Elements that end by themselves where the next begins.
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                ends = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        del stack[k:]
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "div", "article", "section"):
                        break
            else:
                while stack[-1].tag == "p" or stack[-1].tag in _INLINE and any(e.tag == "p" for e in stack):
                    stack.pop()
            anchors = sum(e.tag == "a" for e in stack)
        number += 1
        context, in_article, skip, closed = _said(tag, attributes or "", stack[-1])
        if not (attributes or "").rstrip().endswith("/") or tag not in ("svg", "math"):
            stack.append(_Open(tag, number, context, in_article, skip, stack[-1].number, closed))
            anchors += tag == "a"
        if tag in _RAW:
            close = re.compile(rf"</{tag}", re.I).search(html, at)
            at = close.start() if close else n
    end()
    return out


def _score(text: str, linked: int, held: _Open) -> float:
    """Log-odds of content from the block itself and where it stands."""
    words = text.count(" ") + 1
    score = held.context + min(words, 40) / 20 - 1.0
    density = linked / max(len(text), 1)
    score -= 4.0 * density * (density > 0.5)
    if held.tag in ("p", "blockquote", "pre"):
        score += 1.0
    elif held.tag in ("li", "td", "th", "dt"):
        score -= 0.5
    elif held.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += 0.5
    return score


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; ties go to the sink's side.

    ``costs``: capacity from the source if positive, to the sink if negative."""
    n = len(costs)
    u = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # fix what no edge can turn
        i = queue.popleft()
        if label[i] is not None or abs(u[i]) <= sum(near[i].values()):
            continue
        label[i] = u[i] > 0
        for j, w in near[i].items():
            u[j] += w if label[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        _flow(rest, u, near, label)
    return [bool(x) for x in label]


def _flow(rest: list[int], u: list[float], near: list[dict[int, float]], label: list) -> None:
    """Shortest augmenting paths in levels over the nodes that are left."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in rest:
        cap[i] = dict(near[i])
    for i in rest:
        if u[i] > 0:
            cap[source][i], cap[i][source] = u[i], 0.0
        elif u[i] < 0:
            cap[i][sink], cap[sink][i] = -u[i], 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            break
        ways = {a: iter(list(cap[a])) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(cap[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    cap[x][y] -= flow
                    cap[y][x] += flow
                path = [source]
                ways[source] = iter(list(cap[source]))
                continue
            for b in ways[a]:
                if cap[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()
                level[a] = -1
    for i in rest:
        label[i] = i in level


def main_text(html: str | None) -> str:
    found = blocks(html) if html else []
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, _NEAR))
        if b.parent in last:
            edges.append((last[b.parent], i, _SIBLING))
        last[b.parent] = i
    content = min_cut([b.score for b in found], edges)
    return "\n".join(b.text for b, c in zip(found, content, strict=True) if c)


def extract(pages: DataFrame, html: str = "html", keep_html: bool = True) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points). No shuffle."""

    def run(b: pa.RecordBatch) -> list:
        texts = [main_text(x.as_py()) for x in column(b, html)]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return with_columns(pages, "text string, n_chars long", run, () if keep_html else (html,))


def query(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), keep_html=False)
