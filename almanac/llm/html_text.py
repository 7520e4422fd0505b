"""HTML extraction by tag-path ratios.

A page becomes a sequence of text blocks, each under its root-to-leaf path of block-level tags with their
classes. What markup itself declares not to be content (scripts, menus, headers, footers, asides, forms, by
tag or role, and what is hidden) takes no part. For each path, text outside links and punctuation are added up over its
blocks; the ratios of text to blocks and of punctuation to blocks, both smoothed along the page, are
fused, and paths over a threshold (a share of the fused ratios' standard deviation) hold the content.

Words in classes and ids (advert, sidebar, comments ...) are evidence beside the ratios: a plain mark takes
its element out unless that element holds most of the page's text; a doubtful one (an id like
"discussion", a word among others) only if the element's own ratio is under the threshold or most of its text is links.

Content nodes: where the page marks articles (or else its main part), those that hold a content path, whole but
for what is taken out; teasers, articles that are mostly links or marked so, only where there are no others. Elsewhere the
blocks of the content paths, with headings before and short blocks between them.

Defined cases: null or empty html: empty text; no content path: all blocks that took part; white
space alone is no block; a tag whose quotes don't close ends at its first ">"; repeated rows are read each;
an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)(?:((?:[^<>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*)>|([^<>]*)>)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|["']?([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template svg math nav header footer aside form button select textarea iframe object canvas dialog menu title audio video map xmp noembed noframes datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status note".split())
#: Words of classes and ids that are plain marks, and those that are plain only as a whole class.
PLAIN = (
    "adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored promo promoted banner sidebar side-bar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments respond disqus cookie cookies "
    "consent gdpr popup modal overlay newsletter subscribe subscription signup login sharing sharebar "
    "recommended recommendations pagination pager toolbar widget widgets skip-link site-header site-footer page-header page-footer"
).split()
DOUBTFUL = "ad ads promotion reply replies discussion notice notices alert social share related toc teaser".split()


def _marks(words: list[str]) -> re.Pattern:
    """Tokens that are one of the words, with others around it."""
    return re.compile(r"(?:(?!with-|has-|no-|without-|is-)(?:[\w]+[-_])*?)(?:" + "|".join(map(re.escape, words)) + r")(?:[-_]\w+)*\Z", re.I)


IS_PLAIN, IS_DOUBTFUL = _marks(PLAIN), _marks(DOUBTFUL)
WHOLE_PLAIN, WHOLE_CLASS = frozenset(PLAIN), frozenset(PLAIN + DOUBTFUL)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNMARKED = frozenset("html body main article".split())
#: An opening tag closes those open ones, up to a tag of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset()),
}
HELD = frozenset("html body main article section div table td th ul ol dl blockquote".split())
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


#: What an element's classes and ids say of it.
CLEAR, MAYBE, MARKED = 0, 1, 2


def read(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, str]:
    """(never content by its markup, mark, path step) of an opening tag."""
    step, mark = tag, CLEAR
    if tag in NEVER:
        return True, mark, step
    if not attributes:
        return False, mark, step
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if name == "class" and tag not in INLINE:
                step = ".".join([tag, *sorted({re.sub(r"\d+", "", x) for x in value.split()})])
            if tag in UNMARKED and tag != "article" or in_article and tag in HEADINGS:
                continue
            for token in value.split():
                low = token.lower()
                if low in (WHOLE_CLASS if name == "class" else WHOLE_PLAIN):
                    mark = MARKED
                elif IS_PLAIN.match(token):
                    mark = max(mark, MARKED if name == "class" or not in_article else MAYBE)
                elif IS_DOUBTFUL.match(token):
                    mark = max(mark, MAYBE)
        elif tag in ("html", "body"):
            continue
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, mark, step
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, mark, step
    return False, mark, step


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    #: The article and the main part that it stands in, from 1; 0 outside.
    where: tuple[int, int]
    #: Characters of links.
    linked: int
    #: The outermost marked and the outermost doubtful element around it, from 1; 0 without.
    marked: int
    doubtful: int
    heading: bool


def blocks(page: str) -> list[Block]:
    """The text blocks in page order, without regions that markup declares not to be content."""
    out, text, linked = [], [], 0
    stack: list[tuple[str, bool, int, str]] = []  # tag, never, mark, path step
    skip = links = headings = elements = 0
    around = {MAYBE: [], MARKED: []}  # open elements of each mark, by number
    depth, number = {"article": 0, "main": 0}, {"article": 0, "main": 0}

    def flush() -> None:
        nonlocal linked
        joined = SPACES.sub(" ", "".join(text)).strip()
        if joined and not skip:
            first = [around[m][0] if around[m] else 0 for m in (MARKED, MAYBE)]
            out.append(Block(tuple(x for t, _, _, x in stack if t not in INLINE), joined, tuple(number[x] * (depth[x] > 0) for x in depth), min(linked, len(joined)), *first, headings > 0))
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal skip, links, headings
        tag, bad, mark, _ = stack.pop()
        skip -= bad
        if mark:
            around[mark].pop()
        if tag in depth:
            depth[tag] -= 1
        links -= tag == "a"
        headings -= tag in HEADINGS

    def close(tags, stop) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in stop:
                return
            if stack[i][0] in tags:
                flush()
                while len(stack) > i:
                    pop()
                return

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not skip:
            piece = entities.unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text.append(m[0][9:-3])
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
        if m[1]:
            if tag == "br" or tag == "p" and all(x[0] != "p" for x in stack):
                text.append(" ")
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE:
                        flush()
                    while len(stack) > i:
                        pop()
                    break
                if tag in INLINE and stack[i][0] in HELD:
                    break
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS:
                close(*ENDS[tag])
            else:
                close(frozenset(["p"]), HELD)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if attributes.endswith("/") and tag not in INLINE and tag not in HELD:
            continue
        bad, mark, step = read(tag, attributes, depth["article"] > 0)
        if (bad or mark) and tag in INLINE and not skip:
            flush()
        stack.append((tag, bad, mark, step))
        skip += bad
        if mark:
            elements += 1
            around[mark].append(elements)
        if tag in depth:
            number[tag] += depth[tag] == 0
            depth[tag] += 1
        links += tag == "a"
        headings += tag in HEADINGS
    flush()
    return out


def smooth(x: list[float]) -> list[float]:
    """A Gaussian window of two blocks on both sides."""
    by = [math.exp(-i * i / 2) for i in range(-2, 3)]
    out = []
    for i in range(len(x)):
        near = [(x[j], by[j - i + 2]) for j in range(max(0, i - 2), min(len(x), i + 3))]
        out.append(sum(a * b for a, b in near) / sum(b for _, b in near))
    return out


def plain(found: list[Block]) -> int:
    """Characters outside links."""
    return sum(len(b.text) - b.linked for b in found)


def unmarked(found: list[Block]) -> list[Block]:
    """The blocks outside marked elements; a mark around most of the page's text doesn't count."""
    by = defaultdict(int)
    for b in found:
        by[b.marked] += len(b.text) - b.linked
    most = {m for m, n in by.items() if m and 2 * n > sum(by.values())}
    return [b for b in found if not b.marked or b.marked in most]


def ratios(found: list[Block]) -> dict[tuple[str, ...], float]:
    """The fused ratio of each path: text and punctuation to its blocks, smoothed along the page."""
    sums: dict[tuple, list[float]] = defaultdict(lambda: [0, 0, 0])
    for b in found:
        s = sums[b.path]
        s[0] += len(b.text) - b.linked
        s[1] += len(PUNCTUATION.findall(b.text)) * (len(b.text) - b.linked) / len(b.text)
        s[2] += 1
    length = smooth([sums[b.path][0] / sums[b.path][2] for b in found])
    marks = smooth([(1 + sums[b.path][1]) / sums[b.path][2] for b in found])
    fused: dict[tuple, list[float]] = defaultdict(list)
    for b, x, y in zip(found, length, marks, strict=True):
        fused[b.path].append(x * y)
    return {p: sum(x) / len(x) * (sums[p][0] > 0) for p, x in fused.items()}


def own_ratio(found: list[Block]) -> float:
    """The fused ratio of an element's blocks alone, headings aside."""
    body = [b for b in found if not b.heading]
    return plain(body) * (1 + sum(len(PUNCTUATION.findall(b.text)) for b in body)) / len(body) ** 2 if body else 0.0


def threshold(by_path: dict, found: list[Block], share: float) -> float:
    """A share of the standard deviation of the blocks' fused ratios."""
    values = [by_path[b.path] for b in found]
    mean = sum(values) / len(values)
    return share * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def content(page: str | None, share: float = 0.4) -> str:
    """The main text of a page."""
    found = unmarked(blocks(page or ""))
    if not found:
        return ""
    by_path = ratios(found)
    floor = threshold(by_path, found, share)
    over = {p for p, v in by_path.items() if v >= floor and v > 0}
    typical = sum(by_path[b.path] for b in found) / len(found)
    # a doubtful element stays if its own blocks are like content and most of its text is no link
    groups = defaultdict(list)
    for b in found:
        groups[b.doubtful].append(b)
    whole = plain(found)
    out = {m for m, bs in groups.items() if m and 2 * plain(bs) <= whole and (2 * plain(bs) <= sum(len(b.text) for b in bs) or own_ratio(bs) < max(floor, share * typical))}
    found = [b for b in found if b.doubtful not in out] or found
    return " ".join(b.text for b in nodes(found, over))


def nodes(found: list[Block], over: set) -> list[Block]:
    """The blocks of the content nodes; ``over``: the paths over the threshold."""
    for part in (0, 1):
        marked = {b.where[part] for b in found} - {0}
        if marked:
            kept = {b.where[part] for b in found if b.path in over} & marked or marked
            # teasers: articles that are mostly links, or doubtful by their class
            parts = {k: [b for b in found if b.where[part] == k] for k in kept}
            real = {k for k, bs in parts.items() if 2 * plain(bs) > sum(len(b.text) for b in bs) and not all(b.doubtful for b in bs)}
            return [b for b in found if b.where[part] in (real or kept)]
    keep = [b.path in over for b in found]
    if not any(keep):
        return found
    # headings before content, and short blocks between two content blocks, belong to it
    for i in range(len(found) - 2, -1, -1):
        if not keep[i] and found[i].heading and keep[i + 1]:
            keep[i] = True
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    for i in range(first, last):
        if not keep[i] and keep[i - 1] and any(keep[i + 1 : i + 3]) and found[i].linked * 2 < len(found[i].text):
            keep[i] = True
    return [b for b, k in zip(found, keep, strict=True) if k]


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, url, text, n_chars: one row for each row of pages."""

    def run(rows: list) -> list[tuple]:
        return [(t, len(t)) for t in (content(x) for x in rows)]

    both = pages.select(F.struct(F.col(key).alias("k"), F.col(url).alias("u")).alias("row"), F.col(html).alias("html"))
    return per_text(both, run, "text string, n_chars long", "html", "row").select(F.col("row.k").alias(key), F.col("row.u").alias(url), "text", "n_chars")
