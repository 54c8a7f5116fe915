"""Main text of HTML pages by tag-path ratios.

Every text node hangs on a path of tags from the root. For each path the length
of text and the punctuation of its nodes are summed, relative to the number of
nodes; both ratios are smoothed over paths that are near in the tree, fused, and
held against a threshold. Classes, names and a title nearby only shift a path's
score; elements that never hold an article (menus, forms, hidden ones) score 0. The nodes of paths
above the threshold are the seeds of the content. The article is the smallest
element that holds all of them; other paths in it are kept or dropped by a
second, weaker threshold on their own ratio.

All steps are linear in the page: elements and paths are numbers, and no step
walks up the tree again for each node.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rippletrace.llm.common import add_columns

# What HTML says about elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Not part of an article, wherever they stand.
AWAY = frozenset("nav footer aside form button select option dialog menu svg canvas object audio video map head fieldset".split()) | RAW
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table td th ul ol dl div section article main body html blockquote".split())
# Words in class, id or role that name another purpose than the article's.
_OTHER = re.compile(
    r"(?<![a-z])(ads?|adverts?|advertisements?|advertising|adsense|banners?|breadcrumbs?|captcha|comments?|commentlist|cookies?|consent|disqus|disclaimers?"
    r"|dropdown|footers?|gdpr|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notifications?|pagination|pager|paywall|popups?|promos?|promotions?"
    r"|recommend(?:ed|ations?)?|related|replies|reviews?|respond|search|share|sharing|shares|sidebars?|skip|social|sponsors?|sponsored|subscribe|subscription"
    r"|tags|toolbar|topbar|trackbacks?|widgets?|contentinfo|complementary|alert)(?![a-z])"
)
_ARTICLE = re.compile(r"(?<![a-z])(article|articlebody|post|entry|story|main)(?![a-z])")
# What a path's score is multiplied by if it is marked as of another purpose, as an
# article, or lies in the element that holds the title.
OTHER_WEIGHT, ARTICLE_WEIGHT, TITLED_WEIGHT = 1e-6, 2.0, 4.0
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PUNCTUATION = re.compile(r"[,.;:!?…、。，！？¿¡]")


class Block:
    """Text without a block boundary inside, the number of its element and of its path."""

    __slots__ = ("owner", "path", "parts", "linked", "text")

    def __init__(self, owner: int, path: int) -> None:
        self.owner, self.path, self.parts, self.linked, self.text = owner, path, [], 0, ""


class Page:
    """The elements of a page, its tag paths and its blocks of text.

    Elements and paths are numbered, parents before children; 0 is the root.
    An element's label is its tag with its classes, and a path is known by its
    parent, its label and what it is marked as.
    """

    def __init__(self) -> None:
        self.parent, self.path, self.tag = [-1], [0], ["#"]  # of elements
        self.above, self.depth, self.away, self.other, self.article = [-1], [0], [False], [False], [False]  # of paths
        self.blocks: list[Block] = []
        self._known: dict[tuple, int] = {}

    def add(self, parent: int, tag: str, label: str, away: bool, other: bool, article: bool) -> int:
        above = self.path[parent]
        away, other, article = away or self.away[above], other or self.other[above], article or self.article[above]
        path = self._known.setdefault((above, label, away, other, article), len(self.above))
        if path == len(self.above):
            self.above.append(above)
            self.depth.append(self.depth[above] + 1)
            self.away.append(away)
            self.other.append(other)
            self.article.append(article)
        self.parent.append(parent)
        self.path.append(path)
        self.tag.append(tag)
        return len(self.parent) - 1

    def weight(self, path: int) -> float:
        """What marks shift the score of a path by."""
        return OTHER_WEIGHT if self.other[path] else ARTICLE_WEIGHT if self.article[path] else 1.0


def _attributes(raw: str) -> tuple[bool, bool, bool, str]:
    """Whether they hide it, name another purpose, name an article, and the class for the path."""
    hidden = other = article = False
    label = ""
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            split = re.sub(r"[-_]", " ", value)
            other |= bool(_OTHER.search(split))
            article |= bool(_ARTICLE.search(split))
            if name == "class":
                label = "." + ".".join(sorted(value.split()))
    return hidden, other, article and not other, label


class _Open:
    """The elements that are open, and where in the stack those of each tag are."""

    def __init__(self) -> None:
        self.stack, self.at, self.scopes = [0], {}, [0]

    def push(self, element: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(element)

    def last(self, *tags: str) -> int:
        """Where the innermost element of ``tags`` is; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, position: int, page: Page) -> None:
        """End the element there and all inside it."""
        while len(self.stack) > max(position, 1):
            tag = page.tag[self.stack.pop()]
            self.at[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()


def parse(source: str) -> Page:
    """A page's elements, paths and blocks in order.

    Unclosed and misnested elements are taken as browsers do in the common
    cases: a block ends an open paragraph, an item its predecessor, and an end
    tag what is open inside its element. Inline elements are no part of paths.
    """
    page, open_, current, links, at, n = Page(), _Open(), None, 0, 0, len(source)

    def add(data: str) -> None:
        nonlocal current
        if not data:
            return
        if current is None:
            if data.isspace():
                return
            current = Block(open_.stack[-1], page.path[open_.stack[-1]])
            page.blocks.append(current)
        text = html.unescape(data)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    while m := _MARK.search(source, at):
        add(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending = name.lower(), bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if ending else 1))
            elif tag == "br":
                add(" ")
            continue
        current = None
        if ending:
            if open_.at.get(tag):
                open_.close(open_.at[tag][-1], page)
            continue
        attributes = (m[3] if m[2] else m[6]) or ""
        if tag in ENDS_P and page.tag[open_.stack[-1]] == "p":
            open_.close(len(open_.stack) - 1, page)
        if tag in ENDS_OWN:
            own = open_.last(*ENDS_OWN[tag])
            if own and own >= open_.scopes[-1]:
                open_.close(own, page)
                if tag == "tr" and page.tag[open_.stack[-1]] == "tr":
                    open_.close(len(open_.stack) - 1, page)
        if tag == "body" and page.tag[open_.stack[-1]] == "head":
            open_.close(len(open_.stack) - 1, page)
        if tag in VOID:
            continue
        here = open_.stack[-1]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else n
            continue
        away, other, article, label = _attributes(attributes) if attributes else (False, False, False, "")
        # A page's header isn't the article's; an article's own header holds its title.
        away |= tag in AWAY or (tag == "header" and not page.article[page.path[here]])
        inner = tag not in ("html", "body")
        open_.push(page.add(here, tag, tag + label, away and inner, other and inner, article or tag in ("article", "main")), tag)
    add(source[at:])
    for b in page.blocks:
        b.text = " ".join("".join(b.parts).split())
    page.blocks = [b for b in page.blocks if b.text]
    return page


def titled_paths(page: Page) -> list[bool]:
    """Whether each path lies below one that holds a first-level heading; text right in that one may be of another element."""
    tops = {page.above[b.path] for b in page.blocks if page.tag[b.owner] == "h1" and not page.away[b.path] and not page.other[b.path]}
    titled = [False] * len(page.above)
    for p in range(1, len(titled)):
        titled[p] = page.above[p] in tops or titled[page.above[p]]
    return titled


def path_scores(page: Page, spread: float = 1.0) -> dict[int, float]:
    """The fused ratio of each tag path that has text.

    Per path: characters outside links per node, and punctuation per node. Each
    is smoothed over paths with weights that fall with the number of steps
    between two paths in the tree. A path's own ratios and the smoothed ones are
    multiplied, and the geometric mean of the two products is the score. Marks
    multiply it by their weight; it is 0 in elements that hold no article.
    """
    sums: dict[int, list[float]] = {}
    for b in page.blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += max(len(b.text) - b.linked, 0)
        s[1] += len(_PUNCTUATION.findall(b.text)) if b.linked < len(b.text) / 2 else 0
        s[2] += 1
    ends = np.fromiter(sums, "int64", len(sums))
    # Two nodes without text are added to each path: a path of a single node tells little.
    ratio = np.array([[s[0] / (s[2] + 2), 1 + s[1] / (s[2] + 2), 1.0] for s in sums.values()])
    # ``below`` sums the paths under a node by their steps from it, ``near`` all
    # paths. Beyond ``reach`` steps a weight is less than 1e-13 of a path's own.
    above, depth = np.array(page.above), np.array(page.depth)
    reach = int(np.ceil(8 * spread)) + 1
    below = np.zeros((len(above), reach, 3))
    below[ends, 0] = ratio
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    for level in reversed(levels[1:]):
        np.add.at(below[:, 1:], above[level], below[level, :-1])
    near = below.copy()
    for level in levels[1:]:
        near[level, 1:] += near[above[level], :-1]
        near[level, 2:] -= below[level, :-2]
    kernel = np.exp(-((np.arange(reach) / spread) ** 2) / 2)
    summed = np.einsum("t,ptc->pc", kernel, near[ends])
    smooth = summed[:, :2] / summed[:, 2:]
    fused = np.sqrt(smooth.prod(axis=1) * ratio.prod(axis=1))
    titled = titled_paths(page)
    return {p: 0.0 if page.away[p] else s * page.weight(p) * (TITLED_WEIGHT if titled[p] else 1.0) for p, s in zip(sums, fused.tolist())}


def prose_paths(page: Page, least: float = 0.5) -> set[int]:
    """Paths with the share ``least`` of their characters outside links.

    Marks multiply the share by their weight; and to that of a path in a marked
    article the share of all of the article is added, as links in prose are part of it.
    """
    sums: dict[int, list[int]] = {}
    for b in page.blocks:
        s = sums.setdefault(b.path, [0, 0])
        s[0] += max(len(b.text) - b.linked, 0)
        s[1] += len(b.text)
    marked = [s for p, s in sums.items() if page.article[p] and not page.away[p] and not page.other[p]]
    whole = sum(s[0] for s in marked) / max(sum(s[1] for s in marked), 1)
    return {p for p, (free, all_) in sums.items() if not page.away[p] and (free / all_ + page.article[p] * whole) * page.weight(p) > least}


def main_text(source: str | None, threshold: float = 0.3, beside: float = 0.1) -> str:
    """The article of a page: its blocks joined by newlines; empty if there is none.

    Paragraphs next to the element of the seeds, whose paths reach the share
    ``beside`` of the best score, belong to the article too, as a lead does.
    """
    page = parse(source) if source else None
    if not page or not page.blocks:
        return ""
    scores = path_scores(page)
    best = max((s for p, s in scores.items() if not page.other[p]), default=0.0)
    if best <= 0:
        return ""
    seed = {p for p, s in scores.items() if s >= threshold * best}
    # The deepest element that holds all seeds: children have larger numbers.
    held = [0] * len(page.parent)
    for b in page.blocks:
        held[b.owner] += b.path in seed
    total = sum(held)
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    inside = max(e for e, n in enumerate(held) if n == total)
    if page.tag[inside] == "p" or page.tag[inside] in HEADINGS:
        inside = page.parent[inside]
    while page.article[page.path[inside]] and page.article[page.path[page.parent[inside]]] and page.tag[page.parent[inside]] != "main":
        inside = page.parent[inside]
    leads = {page.parent[b.owner] for b in page.blocks if page.tag[b.owner] == "p" and scores[b.path] >= beside * best}
    while inside and page.parent[inside] in leads:
        inside = page.parent[inside]
    within = [False] * len(page.parent)
    for e in range(inside, len(within)):
        within[e] = e == inside or within[page.parent[e]]
    content = seed | prose_paths(page)
    kept = [within[b.owner] and b.path in content for b in page.blocks]
    if page.tag[inside] not in ("#", "html", "body") and not page.article[page.path[inside]]:
        # A title above the element, and what stands between the two.
        first = kept.index(True)
        titles = [i for i, b in enumerate(page.blocks[:first]) if page.tag[b.owner] in HEADINGS and page.parent[b.owner] == page.parent[inside]]
        for i in range(titles[0], first) if titles else ():
            kept[i] = page.blocks[i].path in content
    return "\n".join(b.text for b, k in zip(page.blocks, kept) if k)


def extract_main_text(pages: DataFrame, source: str = "html", into: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add the main text of every page's whole HTML as column ``into``.

    Character references are decoded, white space inside a block becomes one
    space, blocks keep their order and are joined by one newline. A null, empty
    or text-less page gives the empty string; text without any markup is one
    block. The new column replaces one of its name; other columns pass
    unchanged, whatever they hold. Repeated rows give equal texts; an empty
    table gives an empty table. One pass without a shuffle, page by page. With
    ``keep``, only those columns of the input are returned.
    """
    texts = lambda: lambda found: [[main_text(x) for x in found]]
    return add_columns(pages, source, texts, [(into, T.StringType(), pa.string())], keep)
