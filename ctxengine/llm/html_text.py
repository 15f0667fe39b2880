"""Main text of HTML pages by the distribution of text over line blocks.

The markup is stripped to lines, one for each block-level element. Lines inside menus, headers,
footers, sidebars, notices, adverts, forms, reader comments and the like are taken out; what
stands around them stays together. A line that is mostly links has no length. Over the lengths of the
lines that remain a window slides; where the sum of a window rises over the threshold from an empty
block there is a surge point, where it falls to nothing a dive point. The text between surge and dive
is the page's content.

``article`` and ``main`` elements that hold the larger part of the page's unlinked text bound the
content: all that is left inside them is text, but for a run of at least ``window`` lines of links before
the first surge (a menu above the text). Text outside them must
reach the threshold by itself, stand in a span with an ``h1``, or stand right next to
one of them. Where they hold less (teaser cards beside a body in a ``div``) or are missing, spans are sought over
all lines, and the element that encloses a span that reaches the threshold bounds it in the same way, so headings, short paragraphs and
lists of links in it stay.

Names in class, id and role take an element out if they are made of such words and of words of layout
alone ("site-header", "comment-list"); words that may stand for running text too ("related", "social") do so inside an
article only if most of the element's text is links. A name with other words in it ("menu-of-the-day") does so only
if most of the element's text is links. A header inside an article is its own and stays. A form or
a marked element that wraps the page's ``main``, or its ``h1`` and most of its paragraphs, is layout (a
column beside a sidebar, a page in a form) and stays.

Defined results: a null or empty page gives an empty text; markup that never ends is dropped to
its end, an element that never closes bounds nothing; a page is read forward once, in time in
proportion to its length, and kept whole however long; repeated pages are extracted alike; further columns
are not read; an empty table gives an empty result. A line break inside a block is white space.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Lines in a window, and characters in one from which text without a container counts as content.
WINDOW = 3
THRESHOLD = 80
#: Share of linked characters from which a line outside a container is a menu entry, and a container a menu.
LINKED = 0.6

# Elements whose content is never running text, elements that part blocks, void
# elements, and words in class, id and role that mark what isn't the article.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = RAW | frozenset("head nav header footer aside form noscript template object applet svg math canvas audio video map select button datalist dialog menu fieldset label option".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dialog dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | (DROPPED - {"label", "option", "svg", "math", "map"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored sponsors notice notices cookie cookies consent gdpr popup popups modal overlay alert newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus reply replies respond sidebar sidebars aside nav navbar navigation menu menus menubar breadcrumb breadcrumbs toolbar topbar header masthead footer foot footers colophon copyright social share sharing related recommended widget widgets pagination pager skip search searchbox complementary contentinfo".split()
)
CONTAINERS = frozenset(("article", "main"))

# Words of layout, which say nothing about what an element is.
NEUTRAL = frozenset("area article bar blog block body bottom box buttons button card col column container content div entry fixed form global group head icons inner item items large left link links list main mobile outer page panel post posts primary reader right row secondary section site small sticky story text the thread title top user users wide wrap wrapper".split())
# Words that mark an element inside an article only if most of its text is links, as running text may be meant by them.
SOFT = frozenset("social share sharing related recommended widget widgets toolbar topbar pagination pager skip".split())
#: Words that mark a page's header, but not an article's own, nor a paragraph or heading.
_HEADERS = frozenset(("header", "masthead"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=)(?:\s*=\s*(?:(["'])|([^\s>"'][^\s>]*)))?""")
_GAP = re.compile(r"[\s/]*")
_COMMENT_END = re.compile(r"--!?>")
_PART = re.compile(r"[_\-:]+|(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _mark(name: str, attributes: list[tuple[str, str]], inside: bool) -> int:
    """Whether class, id, role or visibility say that an element isn't part of the article: 2 yes, 1 only if it is mostly links, 0 no."""
    strength = 0
    for key, value in attributes:
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
            return 2
        if key not in ("class", "id", "role"):
            continue
        for word in html.unescape(value).split():
            parts = {p.lower() for p in _PART.split(word) if p}
            marks = parts & MARKED
            if marks and not (marks <= _HEADERS and (inside or name in _HEADINGS)):
                sure = all(p in MARKED or p in NEUTRAL or p.isdigit() for p in parts) and not (inside and marks <= SOFT)
                strength = max(strength, 2 if sure else 1)
    return strength


def _tag(page: str, at: int) -> tuple[str, list[tuple[str, str]], bool, int]:
    """(name, attributes, whether it closes itself, its end) of the start tag whose name begins at ``at``; the end is -1 if the page ends first."""
    m = _NAME.match(page, at)
    name, at, attributes, slash = m[0].lower(), m.end(), [], False
    while True:
        gap = _GAP.match(page, at)
        slash, at = gap[0].endswith("/"), gap.end()
        if at >= len(page):
            return name, attributes, slash, -1
        if page[at] == ">":
            return name, attributes, slash, at + 1
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        value = m[3] or ""
        if m[2]:
            close = page.find(m[2], at)
            if close < 0:
                return name, attributes, slash, -1
            value, at = page[at:close], close + 1
        attributes.append((m[1].lower(), value))


def _tokens(page: str) -> list[tuple]:
    """(kind, name, attributes, text); kind is "text", "open", "single" or "close". Raw elements' content is left out.

    Reads forward; markup that never ends takes the rest of the page, so no character is looked at again.
    """
    out: list[tuple] = []
    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            out.append(("text", "", (), page[at:]))
            break
        after = page[low + 1 : low + 2]
        letter = after.isascii() and after.isalpha()
        if not letter and after not in ("/", "!", "?"):  # a "<" of the text
            out.append(("text", "", (), page[at : low + 1]))
            at = low + 1
            continue
        if low > at:
            out.append(("text", "", (), page[at:low]))
        if letter:
            name, attributes, single, at = _tag(page, low + 1)
            if at < 0:
                break
            out.append(("single" if single else "open", name, attributes, ""))
            if name in RAW and not single:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                close = page.find(">", end.end()) if end else -1
                out.append(("close", name, (), ""))
                at = close + 1 if close >= 0 else n
        elif page.startswith("<!--", low):
            end = None if page.startswith((">", "->"), low + 4) else _COMMENT_END.search(page, low + 4)
            at = end.end() if end else page.find(">", low) + 1 if page.startswith((">", "->"), low + 4) else n
        else:
            close = page.find(">", low)
            if close < 0:
                break
            name = _NAME.match(page, low + 2)
            if after == "/" and name and name[0][0].isalpha():
                out.append(("close", name[0].lower(), (), ""))
            at = close + 1
    return out


def _ends(tokens: list[tuple]) -> dict[int, int]:
    """Index of the closing token of each element that is closed; elements left open inside one end with it."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for i, (kind, name, _, _) in enumerate(tokens):
        if kind == "open" and name not in VOID:
            open_at.setdefault(name, []).append(i)
        elif kind == "close" and open_at.get(name):
            ends[open_at[name].pop()] = i
    return ends


def _wrappers(tokens: list[tuple], ends: dict[int, int]) -> Callable[[int], bool]:
    """Whether the element at an index wraps the article, rather than standing beside it."""
    at = {n: [i for i, (kind, name, _, _) in enumerate(tokens) if kind in ("open", "single") and name == n] for n in ("main", "h1", "p")}

    def inside(name: str, i: int) -> int:
        return bisect_left(at[name], ends[i]) - bisect_left(at[name], i)

    return lambda i: bool(inside("main", i) or (inside("h1", i) and 2 * inside("p", i) > len(at["p"])))


def _linked_share(tokens: list[tuple], ends: dict[int, int]) -> Callable[[int], float]:
    """Which share of the text of the element at an index is links."""
    text, linked, links = [0], [0], 0
    for i, (kind, name, _, t) in enumerate(tokens):
        if name == "a" and kind == "open":
            links += i in ends
        elif name == "a" and kind == "close":
            links = max(0, links - 1)
        size = len(t.strip())
        text.append(text[-1] + size)
        linked.append(linked[-1] + (size if links else 0))
    return lambda i: (linked[ends[i]] - linked[i]) / max(1, text[ends[i]] - text[i])


#: Elements of one line; what encloses a text is sought above them, so many levels up at most.
_LEAVES, _LEVELS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address caption figcaption".split()), 64


class _Line:
    """inside: the number of the container that the line stands in, 0 if none; top: whether it is an h1; at: its place; around: the block elements about it,
    from the innermost, as (first, last place, name, those about it)."""

    __slots__ = ("text", "linked", "inside", "top", "at", "around")

    def __init__(self, text: str, linked: int, inside: int, top: bool = False, at: int = 0, around: tuple | None = None):
        self.text, self.linked, self.inside, self.top, self.at, self.around = text, linked, inside, top, at, around


def lines_of(page: str) -> list[_Line]:
    """Lines of the page that have text."""
    tokens = _tokens(page)
    ends = _ends(tokens)
    wraps, share = _wrappers(tokens, ends), _linked_share(tokens, ends)
    lines: list[_Line] = []
    held: list[str] = []
    linked, links, inside, containers, skip_to = 0, 0, 0, 0, -1
    until: list[tuple[int, int]] = []
    top_to = -1
    around: tuple | None = None

    def flush() -> None:
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            lines.append(_Line(text, linked, inside, i <= top_to, i, around))
        held, linked = [], 0

    i = 0
    for i, (kind, name, attributes, text) in enumerate(tokens):
        if i <= skip_to:
            continue
        if kind == "text":
            text = html.unescape(text)  # piece by piece, as a reference never reaches over markup
            held.append(text)
            if links:
                linked += len(text)
            continue
        if kind != "close":
            dropped = False
            if i in ends and name not in ("html", "body", "main"):
                kind_of = 2 if name in DROPPED and not (name == "header" and inside) else _mark(name, attributes, bool(inside)) if attributes else 0
                dropped = kind_of == 2 or (kind_of == 1 and share(i) >= LINKED)
            if dropped and not ((name == "form" or name not in DROPPED) and wraps(i)):
                if name in BLOCKS or name in DROPPED:
                    flush()
                skip_to = ends[i]
                continue
            if name == "br":
                held.append(" ")
            elif name == "a":
                links += i in ends
            elif name in BLOCKS:
                flush()
                if i in ends and name not in ("html", "body"):
                    around = (i, ends[i], name, around)
                if name == "h1":
                    top_to = max(top_to, ends.get(i, -1))
                if name in CONTAINERS and i in ends and not inside:
                    containers += 1
                    until.append((ends[i], containers))
                    inside = containers
        elif name == "a":
            links = max(0, links - 1)
        elif name in BLOCKS:
            flush()
            while around and around[1] <= i:
                around = around[3]
            if until and until[-1][0] == i:
                until.pop()
                inside = 0
    flush()
    return lines


def surges(lengths: np.ndarray, window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Spans (first, past the last) of lines between a surge and a dive point.

    The block of a line is the sum of lengths over the window that starts with it. A surge point
    is a line whose block reaches the threshold; the span reaches from the first line with
    text after the last empty block to the last one before the dive point, where a block is empty.
    """
    if not len(lengths):
        return []
    padded = np.concatenate((lengths, np.zeros(window, lengths.dtype)))
    total = np.concatenate(([0], np.cumsum(padded)))
    block = total[window:][: len(lengths)] - total[: len(lengths)]
    spans, at, n = [], 0, len(lengths)
    empty = block == 0
    while at < n:
        if empty[at]:
            at += 1
            continue
        dive = at
        while dive < n and not empty[dive]:
            dive += 1
        text = at + np.flatnonzero(lengths[at:dive])
        if block[at:dive].max() >= threshold:
            spans.append((int(text[0]), int(text[-1]) + 1))
        at = dive
    return spans


def _enclosing(lines: list[_Line], long: list[int]) -> tuple[int, int] | None:
    """Places of the innermost element that holds all these lines and is more than one line; None if that is the page."""
    around, last = lines[long[0]].around, lines[long[-1]].at
    for _ in range(_LEVELS):
        if around is None or (around[1] >= last and around[2] not in _LEAVES):
            break
        around = around[3]
    return around and (around[0], around[1]) if around and around[1] >= last and around[2] not in _LEAVES else None


def _text_of(rows: list[int], lengths: np.ndarray, window: int) -> list[int]:
    """Lines of an article's element: all but a run of at least ``window`` lines of links that stands before its text."""
    spans = surges(lengths[rows], window, 1)
    return rows[spans[0][0] :] if spans and spans[0][0] >= window else rows


def content(lines: list[_Line], window: int = WINDOW, threshold: int = THRESHOLD) -> list[int]:
    """Indices of the lines that are the page's content, in order."""
    sizes, free = Counter(), Counter()
    for x in lines:
        sizes[x.inside] += len(x.text)
        free[x.inside] += max(0, len(x.text) - x.linked)
    unlinked = sum(free.values())
    # a container that is mostly links is a menu or a teaser, unless all text of the page is linked
    whole = {c for c in sizes if c and sizes[c] and (free[c] > (1 - LINKED) * sizes[c] or not unlinked)}
    bounds = bool(whole) and 2 * sum(free[c] for c in whole) >= unlinked
    lengths = np.array([len(x.text) if x.top or x.linked < LINKED * len(x.text) else 0 for x in lines], np.int64)
    places = [x.at for x in lines]
    out: set[int] = set()
    for inside, group in groupby(range(len(lines)), lambda i: bounds and lines[i].inside in whole):
        rows = list(group)
        if inside:
            out.update(_text_of(rows, lengths, window))
            continue
        every, long = surges(lengths[rows], window, 1), set(surges(lengths[rows], window, threshold))
        bound_to = -1
        for a, b in every:
            if (a, b) in long or (not long and not bounds) or any(lines[i].top for i in rows[a:b]):
                out.update(rows[a:b])
            if (a, b) in long and not bounds and rows[b - 1] > bound_to:  # what the text's own element holds besides
                full = [i for i in rows[a:b] if lengths[i] >= threshold] or rows[a:b]
                ends = _enclosing(lines, full)
                if ends:
                    first, bound_to = bisect_left(places, ends[0]), bisect_right(places, ends[1]) - 1
                    out.update(_text_of(list(range(first, bound_to + 1)), lengths, window))
        if bounds:  # the text right before and after a container
            for edge in (rows if rows[0] else [], rows[::-1] if rows[-1] < len(lines) - 1 else []):
                for i in edge:
                    if lines[i].inside or not lengths[i]:
                        break
                    out.add(i)
    return sorted(out)


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of one page."""
    if not page:
        return ""
    lines = lines_of(page)
    return "\n".join(lines[i].text for i in content(lines, window, threshold))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """(id, url, text, n_chars) for every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [main_text(x.as_py(), window, threshold) for x in b.column(2)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).transform(in_batches, work, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
