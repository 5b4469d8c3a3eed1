"""Main text of web pages by tag-path ratios.

A page's text stands in leaves of its element tree, each with a path of tags
from the root.  Over a whole page the leaves of one path are alike (paragraphs
of an article, entries of a menu), so the page is measured by path: characters
to leaves (text ratio) and punctuation marks to leaves (punctuation ratio).
Both are smoothed along the page with a Gaussian, multiplied, and paths whose
leaves stand out against the page's spread are selected.  Where articles (or
main) hold nearly all of the selected weight, they are the content, whole.  Else
it is the smallest element that holds every selected leaf and title, lifted out
of lists, tables, sections and blocks, without the lists of links beside the
element that holds nearly all of the weight.  All blocks of the content are the
text, headings and short lines included.

Elements that never hold an article's text (scripts, styles, menus, headers and
footers of the page, forms, and those whose class, id or role names such a
part: adverts, comments, notices, sidebars) are left out before the measure.
Class and id words don't count on headings, on what encloses the articles, on
what holds most of the text, or in an article where they name ordinary sections.
There a section, list or paragraph so named goes only where two such words name
it, where it is mostly links, or where it is short and ends the article.  A
heading goes with the left-out part that it stands before and names.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import importable_in_workers

#: Standard deviation of the smoothing, in leaves, and the share of the spread that selects a path.
SMOOTHING = 1.0
SPREAD = 0.3
#: Share of the selected weight that articles, or the element at the heart of the content, hold.
HOLDS = 0.85
#: Share of the text of a page without articles from which names leave no element out, and of links that makes a menu.
MOST = 0.5

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset "
                     "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
                     "ol p pre section table ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HOLDS_P = frozenset("div td th li article section main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are part of a text, never all of it.
PARTS = HEADINGS | frozenset("p li td th tr tbody thead tfoot caption table ul ol menu dl dt dd blockquote pre "
                             "section figure figcaption details summary hgroup header center address".split())
LEFT_OUT = frozenset("head script style noscript template iframe object embed svg math canvas audio "
                     "video map nav menu aside form button select textarea input fieldset label legend "
                     "footer dialog title xmp noembed noframes".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert "
                           "alertdialog menu menubar".split())
# Words of class and id values that name parts outside the article.
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo "
    "promos promotion promotions banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer foot bottombar sidebar sidebars aside rail widget widgets comment "
    "comments commentlist disqus reply replies discussion respond related recommended recommendations "
    "share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr "
    "notice notices popup modal overlay pagination pager skip toolbar copyright legal disclaimer "
    "hidden".split())

# Words of the above that name notes of an article too, left out only outside it; and those that name ordinary
# sections and anchors of it, left out in it only as the class of a wrapper.
NOTES = frozenset("discussion legal disclaimer notice notices copyright header".split())
SUBJECTS = NOTES | frozenset(
    "promotion promotions banner banners nav navigation menu menus footer foot rail widget widgets related "
    "recommended recommendations share sharing social subscription login cookie cookies consent toolbar".split())

ABOUT_OTHERS = frozenset("with has have no non not without".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?",
                        re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：()\"'«»„“”¿¡-]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class _Element:
    __slots__ = ("tag", "parent", "place", "depth", "path", "out", "named", "suspect", "article", "linked")

    def __init__(self, tag: str, parent: "_Element | None", place: int, paths: dict, out: bool,
                 named: bool, article: bool, suspect: int = 0) -> None:
        """``place`` is the element's place in the page; ``paths`` numbers the tag paths."""
        self.suspect = suspect
        self.tag, self.parent, self.place, self.out, self.article = tag, parent, place, out, article
        self.named, self.linked = named, 0
        self.depth = 0 if parent is None else parent.depth + 1
        self.path = paths.setdefault((parent and parent.path, tag), len(paths) + 1)


def _left_out(tag: str, attributes: str, article: bool) -> tuple[bool, bool, int]:
    """Whether an element stands outside any article's text, and whether only its name says that it may.

    Headers inside an article don't.  Last comes 1 for a part of an article
    whose id could name an ordinary section, 2 if its class does.
    """
    if tag in LEFT_OUT or tag == "header" and not article:
        return True, False, 0
    named, suspect = False, 0
    if not attributes:
        return False, False, 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, 0
        if name == "style" and tag not in ("html", "body", "article", "main") and _UNSEEN.search(value):
            return True, False, 0
        if name == "role" and value.lower() in LEFT_OUT_ROLES:
            return True, False, 0
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and tag not in HEADINGS:
            left_out = LEFT_OUT_WORDS
            if article:
                left_out = left_out - (SUBJECTS if name == "id" or tag in PARTS or tag in INLINE else NOTES)
            for name_part in value.split():
                words = {w.lower() for w in _WORDS.findall(name_part)}
                # "page-with-sidebar" is no sidebar.
                if words & ABOUT_OTHERS:
                    continue
                named = named or bool(words & left_out)
                if article and words & LEFT_OUT_WORDS - NOTES:
                    suspect = max(suspect, 2 if name == "class" else 1)
                    named = named or name == "class" and len(words & LEFT_OUT_WORDS) > 1
    return False, named, suspect


def leaves(page: str) -> tuple[list[_Element], list[tuple[_Element, str]]]:
    """All elements, and (block element, raw text) of the blocks, in page order; left-out ones have no text.

    Elements that only their names tell apart keep their text and are ``named``.

    Inline elements belong to their block; a ``br`` ends a line, not a block.
    The work is linear in the page, however deep: closing tags are looked for
    only while such an element is open.
    """
    paths: dict = {}
    root = _Element("html", None, 0, paths, False, False, False)
    elements, opened = [root], Counter()
    current, out, held, at = root, [], [], 0
    inline: list[tuple[str, bool]] = []  # open inline elements of the block, and if left out

    def text(upto: int) -> None:
        if upto > at and not current.out and not any(o for _, o in inline):
            held.append(page[at:upto])
            if any(t == "a" for t, _ in inline):
                current.linked += upto - at

    def flush() -> None:
        if held:
            out.append((current, "".join(held)))
            held.clear()

    def leave(element: _Element) -> _Element:
        flush()
        inline.clear()
        opened[element.tag] -= 1
        return element.parent or root

    while True:
        start = page.find("<", at)
        if start < 0:
            text(len(page))
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a plain "<"
            text(start + 1)
            at = start + 1
            continue
        text(start)
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag or not m.group(4):
            continue
        if m.group(1):
            if tag in INLINE:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == tag:
                        del inline[i]
                        break
                continue
            if opened[tag]:
                while current.tag != tag or current is root:
                    current = leave(current)
                current = leave(current)
            elif tag == "p":
                flush()
            continue
        attributes = m.group(3)
        if tag in INLINE:
            if tag not in VOID:
                inline.append((tag, any(_left_out(tag, attributes, current.article)[:2])))
            continue
        if tag == "br":
            if not current.out:
                held.append(" ")
            continue
        if tag in ("html", "body") and current is not root:
            continue
        if tag in CLOSES_P and opened["p"]:
            up = current
            while up is not root and up.tag != "p" and up.tag not in HOLDS_P:
                up = up.parent
            if up.tag == "p":
                while current is not up:
                    current = leave(current)
                current = leave(current)
        if tag in SIBLINGS and any(opened[x] for x in SIBLINGS[tag][0]):
            same, within = SIBLINGS[tag]
            up = current
            while up is not root and up.tag not in same and up.tag not in within:
                up = up.parent
            if up.tag in same:
                while current is not up:
                    current = leave(current)
                current = leave(current)
                if tag == "tr" and current.tag == "tr":
                    current = leave(current)
        if tag in VOID:
            flush()
            continue
        flush()
        inline.clear()
        article = current.article or tag in ("article", "main")
        gone, named, suspect = _left_out(tag, attributes, current.article)
        current = _Element(tag, current, len(elements), paths, current.out or gone, named, article, suspect)
        elements.append(current)
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            if not current.out:
                held.append(page[at: end.start() if end else len(page)])
            at = end.end() if end else len(page)
            current = leave(current)
    flush()
    return elements, out


def clean(raw: str) -> str:
    """Character references decoded, white space made single spaces, trimmed."""
    return _SPACE.sub(" ", html.unescape(raw)).strip()


def _sums(elements: list[_Element], own: list[float]) -> list[float]:
    """Each element's value with those of all elements below it."""
    total = own[:]
    # Children come after their parents, so sums run up from the page's end.
    for element in reversed(elements[1:]):
        total[element.parent.place] += total[element.place]
    return total


def _below(elements: list[_Element], tops: list[bool]) -> list[bool]:
    """Whether each element is a top or below one."""
    inside = tops[:]
    for element in elements[1:]:
        inside[element.place] = inside[element.place] or inside[element.parent.place]
    return inside


def _of_blocks(elements: list[_Element], blocks: list[tuple[_Element, str]], values) -> list[float]:
    own = [0.0] * len(elements)
    for (element, _), value in zip(blocks, values, strict=True):
        own[element.place] += value
    return _sums(elements, own)


def _without_named(elements: list[_Element], blocks: list[tuple[_Element, str]]) -> list[tuple[_Element, str]]:
    """The blocks outside elements that their class or id leaves out.

    What encloses the articles (or main, without articles) stays, and what
    holds nearly all of its article, or most of a page without any.
    """
    if not any(e.named or e.suspect for e in elements):
        return blocks
    held = _of_blocks(elements, blocks, [len(t) for _, t in blocks])
    kind = next((k for k in ("article", "main") if any(e.tag == k and held[e.place] for e in elements)), None)
    of: list[_Element | None] = [None] * len(elements)  # the outermost article around each element
    level = [0] * len(elements)  # named elements around each
    for e in elements[1:]:
        up = e.parent.place
        of[e.place] = of[up] or (e if e.tag == kind and held[e.place] else None)
        level[e.place] = level[up] + (e.named and of[e.place] is None)
    articles = [e for e in elements if of[e.place] is e]
    # Articles in the fewest named elements are the page's own: others stand among comments and the like.
    least = min((level[e.place] for e in articles), default=0)
    around = _sums(elements, [float(of[e.place] is e and level[e.place] == least) for e in elements])

    def stays(e: _Element) -> bool:
        top = of[e.place]
        if kind and top is None:
            return around[e.place] > 0
        return held[e.place] >= (HOLDS * held[top.place] if top else MOST * held[0])

    tops = [e.named and not stays(e) for e in elements]
    _add_suspects(elements, blocks, held, tops)
    gone = _below(elements, tops)
    kept = []
    for at, (e, t) in enumerate(blocks):
        if gone[e.place]:
            continue
        if e.tag in HEADINGS and at + 1 < len(blocks) and gone[blocks[at + 1][0].place]:
            top = blocks[at + 1][0]
            while gone[top.parent.place]:
                top = top.parent
            if top.parent is e.parent and {w.lower() for w in _WORDS.findall(t)} & LEFT_OUT_WORDS:
                continue
        kept.append((e, t))
    return kept


def _add_suspects(elements: list[_Element], blocks: list[tuple[_Element, str]], held: list[float],
                  tops: list[bool]) -> None:
    """Mark in ``tops`` the suspects that are mostly links, or by class, short, and the last of their article."""
    if not any(e.suspect for e in elements):
        return
    linked = _sums(elements, [float(e.linked) for e in elements])
    for e in elements:
        if e.suspect and linked[e.place] > MOST * held[e.place]:
            tops[e.place] = True
    # An element's blocks stand together in the page.
    first, last = [len(blocks)] * len(elements), [-1] * len(elements)
    for at, (e, _) in enumerate(blocks):
        first[e.place], last[e.place] = min(first[e.place], at), at
    for e in reversed(elements[1:]):
        up = e.parent.place
        first[up], last[up] = min(first[up], first[e.place]), max(last[up], last[e.place])
    home: list[_Element | None] = [None] * len(elements)  # the outermost article (or main) around each
    for e in elements[1:]:
        home[e.place] = home[e.parent.place] or (e if e.tag in ("article", "main") else None)
    below = _below(elements, tops)
    gone = [below[e.place] for e, _ in blocks]
    ends = list(last)  # of each article, without what goes
    for e in sorted((e for e in elements if e.suspect == 2 and last[e.place] >= 0),
                    key=lambda e: (-last[e.place], e.place)):
        top = home[e.place]
        while ends[top.place] >= 0 and gone[ends[top.place]]:
            ends[top.place] -= 1
        if ends[top.place] == last[e.place] and held[e.place] < (1 - HOLDS) * held[top.place]:
            tops[e.place] = True
            gone[first[e.place]: last[e.place] + 1] = [True] * (last[e.place] + 1 - first[e.place])


def _content(elements: list[_Element], blocks: list[tuple[_Element, str]]) -> list[bool]:
    """Whether each element belongs to the content, by tag-path ratios."""
    lengths = np.array([len(t) for _, t in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t in blocks], float)
    paths, of = np.unique(np.array([e.path for e, _ in blocks]), return_inverse=True)
    count = np.bincount(of, minlength=len(paths))
    text_ratio = (np.bincount(of, lengths) / count)[of]
    mark_ratio = (np.bincount(of, marks) / count)[of]
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach ** 2) / (2 * SMOOTHING ** 2))
    kernel /= kernel.sum()

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, 3, mode="edge"), kernel, "valid")

    fused = smooth(text_ratio) * (1 + smooth(mark_ratio))
    by_path = np.bincount(of, fused) / count
    chosen = (by_path >= SPREAD * by_path.std()) if len(paths) > 1 else np.ones(1, bool)
    weight = np.where(chosen[of], lengths, 0.0)
    held = _of_blocks(elements, blocks, weight)
    articles = [e.tag in ("article", "main") and held[e.place] > 0 and not (e.parent and e.parent.article)
                for e in elements]
    if sum(held[e.place] for e in elements if articles[e.place]) >= HOLDS * weight.sum():
        return _below(elements, articles)

    def smallest(held: list[float], least: float) -> _Element:
        best = elements[0]
        for element in elements:
            if held[element.place] >= least and element.depth > best.depth:
                best = element
        # A part of a text is no container: what stands beside it goes with it.
        while best.tag in PARTS and best.parent:
            best = best.parent
        return best

    heart = smallest(held, HOLDS * weight.sum())
    # A title goes with the text, wherever it stands; a line of links tells of no text.
    linked = [float(e.linked) for e in elements]
    told = _of_blocks(elements, blocks, [
        float(e.tag == "h1" or w > 0 and linked[e.place] <= MOST * len(t))
        for (e, t), w in zip(blocks, weight, strict=True)])
    whole = smallest(told, told[0]) if told[0] else heart
    length, linked = _of_blocks(elements, blocks, lengths), _sums(elements, linked)
    menu = _below(elements, [not told[e.place] and linked[e.place] > MOST * length[e.place] for e in elements])
    inner = _below(elements, [e is heart for e in elements])
    outer = _below(elements, [e is whole for e in elements])
    return [i or o and not m for i, o, m in zip(inner, outer, menu, strict=True)]


def main_text(page: str | None) -> str:
    """Main text of a whole page: its blocks in order, one a line; null, empty and textless pages: ''."""
    elements, raw = leaves(page or "")
    blocks = [(e, t) for e, t in ((e, clean(r)) for e, r in raw) if t]
    blocks = _without_named(elements, blocks)
    if not blocks:
        return ""
    inside = _content(elements, blocks)
    return "\n".join(t for e, t in blocks if inside[e.place])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with ``text`` and ``n_chars`` (code points) of its main text.

    The two columns replace columns of the same names, in upper or lower case;
    repeated rows get the same text.  A null, empty or textless page has the
    text '' of 0 characters; no rows give no rows.
    """
    importable_in_workers(pages.sparkSession)

    @F.pandas_udf("string")
    def of_page(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    out = pages.withColumn("text", of_page(F.col(html_col)))
    return out.withColumn("n_chars", F.length("text").cast("long"))
