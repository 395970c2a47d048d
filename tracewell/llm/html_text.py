"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words, the share of them in links, the
same of the blocks before and after it, whether it stands in an article, whether it is a paragraph next to another in one element, and how it is marked: 0 not at all, 1
by a name that parts with links or few words mostly have, 2 by the name of a part that is never article text (advert,
notice, comments), 3 by a tag or role of that kind. A decision tree says which blocks are main text. It is
trained here on `LABELLED`, a small table of blocks labelled by hand. Names mark at 2 only what is a part of a page: an element
whose name has other words too and that has most of the text of what it stands in (`WRAPPER_SHARE`) is a wrapper called after its layout, as with-sidebar or ad-free, and isn't marked.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_groups

# Tags of HTML by kind.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title head datalist".split())
ASIDE_TAGS = frozenset("nav aside footer header form dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Names of parts, as whole parts of a class or id. Parts whose text is none of the article's, however much it is; of these, comments, which an article tag within doesn't lift; parts mostly of links or few words.
PART_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|paywall|popup|modal|overlay|notices?|notifications?|sidebars?|footer|copyright|masthead)(?:$|[\s_-])", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.I)
SOFT_NAMES = re.compile(r"(?:^|[\s_-])(?:banner|aside|rail|widgets?|nav\w*|menus?|breadcrumbs?|topbar|toolbar|header|foot|legal|alert|share|sharing|social|related|recommended|recommendations|trending|reviews?|pagination|pager|search|tags|skip)(?:$|[\s_-])", re.I)

#: Of the free words (in no link, menu, footer or form, nor in a part with no other name) of what a named element stands in, the share from which it is a wrapper; more is asked where readers' comments may be longer than the article.
WRAPPER_SHARE = {"part and more": 0.75, "comments and more": 0.95}
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|$)", re.S)
#: Name and value of each attribute from left to right, so that nothing within a value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")


class Block(NamedTuple):
    text: str
    words: int
    links: float
    article: int
    marked: int
    paragraph: int
    named: int
    sure: bool


class _Open(NamedTuple):
    """An open element, and what holds within it: article, mark, whether an article lifts the mark, skipped, the number of the innermost element that may be a wrapper with a part's name (-1: none), and whether one is a part for sure; block tags up to it, and its own number."""

    tag: str
    article: int
    marked: int
    liftable: bool
    skipped: bool
    named: int
    sure: bool
    blocks: int
    number: int


def _kind(tag: str, attributes: str) -> str:
    """skipped, comments, part (either "and more", if the name has other words), tagged, soft, article or nothing."""
    if tag in SKIPPED_TAGS:
        return "skipped"
    names = ""
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDING.search(value):
                return "skipped"
            if name == "role" and value.lower() in ASIDE_ROLES:
                return "tagged"
            if name in ("class", "id"):
                names += " " + value
    if tag in ASIDE_TAGS:
        return "comments" if names and COMMENT_NAMES.search(names) else "tagged"
    if tag in ("article", "main"):  # it says what it is, whatever it is called
        return "article"
    if names and tag not in ("html", "body"):
        hard = "comments" if COMMENT_NAMES.search(names) else "part" if PART_NAMES.search(names) else ""
        if hard and not all(COMMENT_NAMES.search(n) or PART_NAMES.search(n) for n in _NAME.findall(names)):
            return f"{hard} and more"
        return hard or ("soft" if SOFT_NAMES.search(names) else "")
    return ""


_NAME = re.compile(r"[^\s_-]+")
_MARKS = {"comments": 2, "part": 2, "comments and more": 2, "part and more": 2, "tagged": 3, "soft": 1}


def _opened(tag: str, kind: str, outer: _Open, number: int) -> _Open:
    blocks = outer.blocks + (tag in BLOCK_TAGS)
    new = outer._replace(tag=tag, blocks=blocks, number=number)
    if kind == "article":
        lifted = outer.liftable or not outer.marked  # an article in an unclosed aside counts; one among comments doesn't
        return new._replace(article=1, marked=0 if lifted else outer.marked, liftable=lifted)
    if kind in _MARKS:
        return new._replace(marked=max(outer.marked, _MARKS[kind]), liftable=not kind.startswith("comments") and (outer.liftable or not outer.marked), sure=outer.sure or kind in ("part", "comments"))
    return new._replace(skipped=outer.skipped or kind == "skipped")


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, each with its text (references decoded, white space single) and what is said about it above. Time is linear in the page, however deep it nests; a page with wrappers of a part's name is read twice."""
    out, above, kinds = _blocks(page, frozenset())
    wrappers = _wrappers(out, above, kinds)
    return _blocks(page, wrappers)[0] if wrappers else out


def _wrappers(blocks: list[Block], above: list[int], kinds: list[str]) -> frozenset[int]:
    """Numbers of the elements with a part's name that have most of the text of what they stand in, and so all the way up to the page. above: the named element that each stands in."""
    inside = [0.0] * len(above)
    page = 0.0
    for b in blocks:
        free = b.words * (1 - b.links) if b.marked < 3 and not b.sure else 0.0
        page += free
        if b.named >= 0:
            inside[b.named] += free
    for k in range(len(above) - 1, -1, -1):  # an element has a greater number than what it stands in
        if above[k] >= 0:
            inside[above[k]] += inside[k]
    found: set[int] = set()
    for k, outer in enumerate(above):
        whole = page if outer < 0 else inside[outer]
        if (outer < 0 or outer in found) and whole and inside[k] >= WRAPPER_SHARE[kinds[k]] * whole:
            found.add(k)
    return frozenset(found)


def _blocks(page: str, wrappers: frozenset[int]) -> tuple[list[Block], list[int], list[str]]:
    """(blocks, of each element with a part's name the one that it stands in, its kind). wrappers: those whose names say nothing."""
    out: list[Block] = []
    above: list[int] = []
    kinds: list[str] = []
    stack: list[_Open] = [_Open("", 0, 0, True, False, -1, False, 0, 0)]
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
    parts: list[str] = []
    link_words, links_open, number, last_parent = 0, 0, 0, -1

    def flush() -> None:
        nonlocal link_words, last_parent
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n = len(text.split())
                top, k = stack[-1], places["p"][-1] if places.get("p") else 0
                parent = stack[k - 1].number if k and top.blocks == stack[k].blocks else -1
                out.append(Block(text, n, min(1.0, link_words / n), top.article, top.marked, int(parent >= 0 and parent == last_parent), top.named, top.sure))
                last_parent = parent
            parts.clear()
        link_words = 0

    def close(k: int) -> None:
        """Closes all from the k-th open element on. What has another mark than what follows is a block of its own."""
        if stack[-1][1:7] != stack[k - 1][1:7]:
            flush()
        while len(stack) > k:
            places[stack.pop().tag].pop()

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not stack[-1].skipped:
            parts.append(page[at:stop])
            if links_open:
                link_words += len(page[at:stop].split())
        if not m:
            break
        at = m.end()
        tag = (m[1] or "").lower()
        if m[0].startswith("<![CDATA[") and not stack[-1].skipped:
            parts.append(html.escape(m[0][9:].removesuffix("]]>")))
        if not tag:
            continue
        if m[0][1] != "/":
            if tag == "br" and not stack[-1].skipped:
                parts.append(" ")
            if tag in BLOCK_TAGS:
                flush()
            if tag in ("script", "style", "textarea", "title"):  # raw text up to the end tag
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if not m[3]:
                    at = end.end() if end else len(page)
                continue
            if tag in VOID_TAGS or m[3]:
                continue
            if tag == "a":
                links_open += 1
            if tag == "p" and places.get("p"):  # a paragraph ends where the next begins
                k = places["p"][-1]
                if stack[-1].blocks == stack[k].blocks:
                    close(k)
            number += 1
            kind, own = _kind(tag, m[2]), stack[-1].named
            if kind in WRAPPER_SHARE and tag not in ASIDE_TAGS:
                own = len(above)
                above.append(stack[-1].named)
                kinds.append(kind)
                kind = "" if own in wrappers else kind
            new = _opened(tag, kind, stack[-1], number)._replace(named=own)
            if new[1:7] != stack[-1][1:7]:
                flush()
            places.setdefault(tag, []).append(len(stack))
            stack.append(new)
        else:
            if tag in BLOCK_TAGS:
                flush()
            if tag == "a":
                links_open = max(0, links_open - 1)
            if places.get(tag):
                k = places[tag][-1]
                if tag in BLOCK_TAGS or stack[-1].blocks == stack[k].blocks:
                    close(k)
    flush()
    return out, above, kinds


FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "article", "marked", "paragraph"]
#: Blocks labelled by hand: the features in their order, and 1 for main text; the first ones stand by no paragraph of their element.
_ALONE = np.array(
    [
        # paragraphs, titles and single words within an article, by menus, adverts and each other
        (45, 0.0, 12, 0.0, 60, 0.0, 1, 0, 1), (80, 0.02, 45, 0.0, 30, 0.0, 1, 0, 1), (1, 0.0, 50, 0.0, 70, 0.0, 1, 0, 1), (2, 0.0, 1, 0.0, 3, 0.0, 1, 0, 1),
        (6, 0.0, 4, 1.0, 55, 0.0, 1, 0, 1), (150, 0.0, 9, 0.0, 5, 0.2, 1, 0, 1), (9, 0.0, 6, 0.0, 0, 0.0, 1, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
        (300, 0.05, 4, 1.0, 8, 0.0, 1, 0, 1), (20, 0.0, 2, 1.0, 8, 0.3, 1, 0, 1), (50, 0.0, 20, 0.0, 3, 1.0, 1, 0, 1), (2, 0.0, 80, 0.0, 12, 1.0, 1, 0, 1),
        (6, 0.1, 1, 1.0, 1, 1.0, 1, 0, 1), (4, 0.0, 60, 0.0, 20, 0.9, 1, 0, 1), (110, 0.0, 3, 1.0, 40, 0.8, 1, 0, 1), (1, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1),
        # in an article, a line with links, or that is one link, between text
        (12, 0.5, 30, 0.0, 25, 0.1, 1, 0, 1), (4, 1.0, 40, 0.0, 40, 0.0, 1, 0, 1), (7, 0.6, 50, 0.1, 9, 0.0, 1, 0, 1), (3, 1.0, 12, 0.0, 60, 0.2, 1, 0, 1), (9, 0.9, 70, 0.0, 10, 0.0, 1, 0, 1), (5, 0.8, 6, 0.3, 30, 0.0, 1, 0, 1), (30, 0.6, 22, 0.2, 31, 0.1, 1, 0, 1),
        # lists of links in an article
        (3, 1.0, 4, 1.0, 5, 1.0, 1, 0, 0), (6, 0.9, 5, 1.0, 3, 1.0, 1, 0, 0), (4, 1.0, 60, 0.0, 3, 1.0, 1, 0, 0), (5, 1.0, 4, 1.0, 70, 0.0, 1, 0, 0), (2, 1.0, 2, 1.0, 0, 0.0, 1, 0, 0), (9, 1.0, 5, 0.9, 4, 1.0, 1, 0, 0), (20, 0.9, 18, 0.8, 15, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (7, 0.85, 30, 0.1, 8, 0.9, 1, 0, 0),
        # of soft name: long text with few links, in an article or not
        (90, 0.0, 0, 0.0, 0, 0.0, 1, 1, 1), (60, 0.0, 8, 0.0, 40, 0.0, 1, 1, 1), (45, 0.1, 60, 0.0, 2, 1.0, 1, 1, 1), (60, 0.0, 50, 0.0, 70, 0.0, 0, 1, 1), (120, 0.05, 3, 1.0, 80, 0.0, 0, 1, 1), (50, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (200, 0.1, 90, 0.0, 4, 1.0, 0, 1, 1),
        # of soft name: links and short lines
        (3, 1.0, 60, 0.0, 3, 1.0, 1, 1, 0), (8, 0.0, 90, 0.0, 40, 0.0, 1, 1, 0), (25, 0.6, 9, 0.0, 31, 0.0, 1, 1, 0), (5, 0.6, 90, 0.0, 40, 0.0, 1, 1, 0), (2, 1.0, 1, 1.0, 10, 0.0, 0, 1, 0), (9, 0.0, 1, 1.0, 12, 0.0, 0, 1, 0),
        (30, 0.2, 5, 0.0, 28, 0.3, 0, 1, 0), (45, 0.8, 3, 1.0, 40, 0.9, 0, 1, 0), (60, 0.7, 2, 1.0, 50, 0.8, 0, 1, 0), (1, 0.0, 80, 0.0, 60, 0.0, 0, 1, 0), (20, 0.0, 4, 1.0, 22, 0.0, 0, 1, 0), (12, 0.0, 40, 0.0, 80, 0.0, 1, 1, 0),
        # adverts, notices, comments, and what stands in menus, footers and forms, within an article or not
        (9, 0.0, 1, 1.0, 12, 0.0, 0, 2, 0), (12, 0.0, 80, 0.0, 0, 0.0, 0, 3, 0), (60, 0.0, 70, 0.0, 80, 0.0, 0, 2, 0), (35, 0.1, 2, 1.0, 3, 1.0, 0, 2, 0), (40, 0.0, 60, 0.0, 55, 0.0, 1, 2, 0), (5, 0.6, 90, 0.0, 40, 0.0, 1, 2, 0),
        (25, 0.0, 9, 0.0, 31, 0.0, 1, 2, 0), (100, 0.0, 40, 0.0, 90, 0.0, 0, 2, 0), (8, 0.0, 5, 0.0, 4, 0.0, 0, 3, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 3, 0), (2, 1.0, 1, 1.0, 10, 0.0, 0, 3, 0), (250, 0.0, 60, 0.0, 90, 0.0, 0, 2, 0), (150, 0.0, 40, 0.0, 20, 0.0, 1, 3, 0), (80, 0.0, 90, 0.0, 0, 0.0, 0, 3, 0), (120, 0.0, 0, 0.0, 0, 0.0, 1, 2, 0),
        # pages without an article: long text with few links
        (40, 0.0, 8, 0.0, 50, 0.0, 0, 0, 1), (90, 0.05, 40, 0.0, 70, 0.1, 0, 0, 1), (22, 0.1, 60, 0.0, 45, 0.0, 0, 0, 1), (55, 0.2, 3, 1.0, 60, 0.0, 0, 0, 1), (30, 0.0, 25, 0.0, 2, 1.0, 0, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (70, 0.0, 3, 1.0, 9, 0.0, 0, 0, 1), (25, 0.0, 4, 1.0, 3, 1.0, 0, 0, 1),
        # and short lines between long paragraphs, or before one
        (5, 0.0, 60, 0.0, 80, 0.0, 0, 0, 1), (8, 0.0, 45, 0.05, 40, 0.0, 0, 0, 1), (3, 0.0, 90, 0.0, 35, 0.0, 0, 0, 1), (10, 0.1, 30, 0.0, 52, 0.0, 0, 0, 1), (6, 0.0, 3, 1.0, 70, 0.0, 0, 0, 1), (4, 0.0, 1, 1.0, 45, 0.0, 0, 0, 1), (9, 0.0, 5, 0.5, 60, 0.0, 0, 0, 1),
        # lists of links, labels, single lines of the page's frame
        (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0), (20, 0.9, 3, 1.0, 18, 0.8, 0, 0, 0), (45, 0.8, 20, 0.9, 5, 1.0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), (7, 0.0, 3, 0.5, 6, 0.7, 0, 0, 0), (6, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0),
        (9, 0.0, 55, 0.0, 0, 0.0, 0, 0, 0), (2, 0.0, 5, 0.0, 4, 0.0, 0, 0, 0), (5, 1.0, 70, 0.0, 60, 0.0, 0, 0, 0), (30, 0.7, 50, 0.0, 4, 1.0, 0, 0, 0), (8, 0.4, 4, 1.0, 9, 0.0, 0, 0, 0), (3, 1.0, 50, 0.0, 2, 1.0, 0, 0, 0), (12, 0.0, 80, 0.0, 3, 1.0, 0, 0, 0), (4, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0),
    ]
)
_BESIDE = np.array(
    [
        # paragraphs after a paragraph of the same element: text, however short, and rows of links
        (3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 1), (12, 0.0, 45, 0.1, 0, 0.0, 0, 0, 1, 1), (2, 0.0, 20, 0.0, 3, 1.0, 0, 0, 1, 1), (7, 0.0, 8, 0.0, 4, 0.9, 0, 0, 1, 1), (70, 0.0, 60, 0.0, 5, 0.0, 0, 0, 1, 1), (30, 0.2, 25, 0.0, 2, 1.0, 0, 0, 1, 1),
        (4, 0.0, 30, 0.0, 0, 0.0, 0, 0, 1, 1), (9, 0.0, 55, 0.0, 0, 0.0, 0, 0, 1, 1), (12, 0.0, 80, 0.0, 3, 1.0, 0, 0, 1, 1), (1, 0.0, 90, 0.0, 12, 0.5, 0, 0, 1, 1),
        (3, 1.0, 4, 1.0, 5, 1.0, 0, 0, 1, 0), (6, 0.9, 60, 0.0, 3, 1.0, 0, 0, 1, 0), (25, 0.8, 20, 0.9, 18, 1.0, 0, 0, 1, 0), (8, 1.0, 40, 0.0, 0, 0.0, 0, 0, 1, 0),
        (9, 0.0, 14, 0.0, 0, 0.0, 0, 1, 1, 0), (12, 0.0, 9, 0.0, 11, 0.0, 0, 1, 1, 0), (40, 0.0, 60, 0.0, 30, 0.0, 0, 2, 1, 0), (6, 0.0, 9, 0.0, 0, 0.0, 0, 3, 1, 0), (35, 0.0, 20, 0.0, 0, 0.0, 1, 2, 1, 0), (60, 0.0, 70, 0.0, 50, 0.0, 0, 1, 1, 1),
        (3, 0.0, 60, 0.0, 0, 0.0, 1, 0, 1, 1), (25, 0.1, 40, 0.0, 30, 0.0, 1, 0, 1, 1), (4, 1.0, 40, 0.0, 40, 0.0, 1, 0, 1, 1), (5, 1.0, 6, 1.0, 4, 1.0, 1, 0, 1, 0),
    ]
)
LABELLED = np.concatenate([np.insert(_ALONE, len(FEATURES) - 1, 0, axis=1), _BESIDE])


def grow(x: np.ndarray, y: np.ndarray, least: int = 1) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, below, above), or (share of ones,) at a leaf."""
    if y.min() == y.max() or len(y) < 2 * least:
        return (float(y.mean()),)
    best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            if least <= low.sum() <= len(y) - least:
                impurity = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                best = min(best, (float(impurity), f, float(cut)))
    if best[1] < 0:
        return (float(y.mean()),)
    low = x[:, best[1]] < best[2]
    return best[1], best[2], grow(x[low], y[low], least), grow(x[~low], y[~low], least)


def trained_tree(labelled: np.ndarray = LABELLED) -> tuple:
    return grow(labelled[:, :-1], labelled[:, -1])


def says(tree: tuple, x: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(page: str, tree: tuple) -> str:
    blocks = blocks_of(page)
    frame = Block("", 0, 0.0, 0, 0, 0, -1, False)
    kept = []
    for k, b in enumerate(blocks):
        p, n = blocks[k - 1] if k else frame, blocks[k + 1] if k + 1 < len(blocks) else frame
        if says(tree, (b.words, b.links, p.words, p.links, n.words, n.links, b.article, b.marked, b.paragraph)):
            kept.append(b.text)
    return " ".join(kept)


CHUNK_CHARS = 4_000_000


def extract(table: DataFrame, tree: tuple | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row. A null html counts as empty and has an empty text; a page without main text too; repeated rows and null ids or urls give a row each; other columns are ignored."""
    tree = tree or trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, pages in text_groups(batch, CHUNK_CHARS, "html"):
                texts = [main_text(h, tree) for h in pages]
                yield pa.RecordBatch.from_arrays([column(batch, "page_id")[x:y], column(batch, "url")[x:y], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
