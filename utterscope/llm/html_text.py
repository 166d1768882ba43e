"""HTML extraction by line-block distribution.

Markup is stripped into lines, one per block element. A line has the length of its text, and zero where it stands in a
menu, header, footer, sidebar, notice, advert, form or reader comments, outside the page's article (where it marks one),
or, on pages that mark none, where links make up most of it. Lengths are summed over a sliding window of lines; a surge
point is where the sum comes up to the threshold, a dive point where it falls below it. The lines of non-zero length
between a surge and its dive are the text. On pages that mark an article, any length is a surge, as nothing of it is to be
dropped (where the marked article has no text, it counts as not marked); on others a window needs `surge` characters, and if none
has them the highest window counts. There the text then grows: lines of the same kind of block (headings go with any) under
the same parent as a line of the text belong to it, however short they are, and so do the headings right before it.

Markup is read as the HTML standard has it: tags, attributes, comments, raw text and the end tags that may be left out. What
is hidden inside a line is left out of it. Names of classes, ids and roles never hide html, body or what holds the first
article. Each character is looked at once.

Defined results: null or empty html gives an empty text of length 0; unclosed or cut-off markup ends at the end of the
page; very long pages are read whole; repeated rows are extracted each; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import partial
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from utterscope.llm.common import map_texts, table

WINDOW = 3
SURGE = 80
LINK_SHARE = 0.5

#: Element names. Fixed values of the HTML standard.
RAW = frozenset("script style title textarea iframe noscript noembed noframes".split())
BOILERPLATE = frozenset(
    "nav header footer aside form dialog menu button fieldset label datalist select template svg math object canvas audio video".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes if they are the innermost block.
_CELLS, _HEADS = ("td", "th"), ("h1", "h2", "h3", "h4", "h5", "h6")
CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "td": _CELLS, "th": _CELLS, "tr": (*_CELLS, "tr"),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (*_CELLS, "tr", "tbody", "thead", "tfoot")), **dict.fromkeys(_HEADS, _HEADS),
}
#: Elements out of which a start tag closes nothing.
BORDERS = frozenset(("select", "object", "template", "svg", "math"))
ARTICLE = frozenset(("article", "main"))
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment "
    "comments disqus replies complementary contentinfo search pagination pager widget".split()
)
#: Those that mark it even if it holds an article: other texts, and what readers wrote.
OTHERS = frozenset("related recommended comment comments disqus discussion replies complementary".split())
#: Words that may stand beside those in a hyphenated name of the same meaning.
BESIDE = frozenset(
    "site global top bottom left right primary secondary main mobile desktop container wrapper wrap box bar list links "
    "block area section slot unit buttons button form posts articles item items x".split()
)
#: Words that mark it wherever they stand in a name, also as the beginning of a part; but not after those of NEGATES.
STRONG = frozenset("comment comments advert adverts ads cookie cookies sidebar sponsored promo disqus newsletter gdpr discussion".split())
BEGINS = ("cookie", "advert", "sidebar", "disqus", "newsletter")
NEGATES = frozenset("has with without no non layout".split())
#: Words that make a name of a part of the page of "header", "footer" or "notice".
OF_PAGE = frozenset("page site privacy legal global".split())

_SPACE = "\t\n\f\r "
_NAME = re.compile(rf"[a-zA-Z][^{_SPACE}/>]*")
_SKIP = re.compile(rf"[{_SPACE}/]*")
_KEY = re.compile(rf"[^{_SPACE}/>][^{_SPACE}/>=]*")
_EQUALS = re.compile(rf"[{_SPACE}]*=[{_SPACE}]*")
_BARE = re.compile(rf"[^{_SPACE}>]*")
_RAW_END = {name: re.compile(rf"</{name}(?=[{_SPACE}/>])", re.I) for name in RAW}
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from `at` on, the first of a name, and the place after the tag; -1 if the page ends in it."""
    found: dict[str, str] = {}
    while True:
        at = _SKIP.match(html, at).end()
        if at == len(html):
            return found, -1
        if html[at] == ">":
            return found, at + 1
        key = _KEY.match(html, at)
        at, value = key.end(), ""
        equals = _EQUALS.match(html, at)
        if equals:
            at = equals.end()
            quote = html[at : at + 1]
            if quote in ("'", '"'):
                end = html.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.setdefault(key[0].lower(), value)


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("open", name, attributes) and ("close", name, {}); raw text and comments are skipped."""
    at, start = 0, 0
    while True:
        less = html.find("<", at)
        if less < 0:
            break
        mark = html[less + 1 : less + 2]
        close = mark == "/"
        name = _NAME.match(html, less + 1 + close)
        if not name and mark not in ("!", "?", "/"):
            at = less + 1  # a plain character
            continue
        if less > start:
            yield "text", html[start:less], {}
        if name:
            attributes, at = _attributes(html, name.end())
            if at < 0:
                return
            tag = name[0].lower()
            if close:
                yield "close", tag, {}
            elif tag in RAW:
                if tag in BLOCKS:
                    yield "close", tag, {}
                end = _RAW_END[tag].search(html, at)
                if not end:
                    return
                at = _attributes(html, end.end())[1]
                if at < 0:
                    return
            else:
                if html[at - 2] == "/":
                    attributes["/"] = ""
                yield "open", tag, attributes
        elif html.startswith("<!--", less):
            short = next((n for n in (5, 6) if html[less + 4 : less + n] in (">", "->")), 0)  # <!--> and <!--->
            end = html.find("-->", less + 4)
            at = less + short if short else (end + 3 if end >= 0 else len(html))
        else:
            end = html.find(">", less)
            at = end + 1 if end >= 0 else len(html)
        start = at
    if start < len(html):
        yield "text", html[start:], {}


def _marks(token: str) -> set[str]:
    """The words of MARKS and STRONG that make a name one of what is not the article."""
    parts = [p for p in _PARTS.split(_CAMEL.sub(r"\1-\2", token).lower()) if p]
    whole = "".join(parts)
    if whole in MARKS or (len(parts) == 1 and whole in STRONG):
        return {whole}
    if NEGATES.isdisjoint(parts):
        strong = {"advert" if p.startswith("advert") else p for p in parts if p in STRONG or p.startswith(BEGINS)}
        if strong:
            return strong
    found = set(parts) & MARKS
    return found if set(parts) <= MARKS | BESIDE | (OF_PAGE if found & {"header", "footer", "notice"} else set()) else set()


def _hides(name: str, attributes: dict[str, str], inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is not part of the article, and whether it would be if it held the first article."""
    if name in BOILERPLATE:
        return not (name == "header" and inside_article), name in ("form", "fieldset")
    if not attributes:
        return False, False
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or _NONE.search(attributes.get("style", "")):
        return True, False
    if name in ("html", "body"):
        return False, False
    found = set()
    for key in ("class", "id", "role"):
        for token in unescape(attributes.get(key, "")).split():
            found |= _marks(token)
    if inside_article:
        found.discard("header")
    if name in ARTICLE and not found & OTHERS:
        return False, False
    return bool(found), not found & OTHERS


class _Open:
    """An open element: whether it hides what it holds, whether that is undone by an article in it, whether it is one."""

    __slots__ = ("name", "hides", "undone", "article", "block", "number")

    def __init__(self, name: str, hides: bool, undone: bool, article: bool, block: bool, number: int):
        self.name, self.hides, self.undone, self.article, self.block, self.number = name, hides, undone, article, block, number


class _Lines:
    """Lines of a page, from its tokens."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # of the open elements of a name
        self.blocks: list[int] = []  # places of the open blocks
        self.hidden = self.depth = self.undone = 0
        self.found = False
        self.texts: list[str] = []
        self.good: list[tuple[bool, bool]] = []  # not hidden, in the article
        self.linked: list[int] = []
        self.kinds: list[tuple[int, str]] = []  # of a line's block: its parent's number, its name
        self.borders: list[int] = []  # places of the open elements of BORDERS
        self.count = 0
        self.parts: list[str] = []
        self.hidden_lines, self.concealed = 0, False
        self.link_chars = 0

    def text(self, piece: str) -> None:
        if self.hidden:
            self.concealed |= not piece.isspace()
            return
        piece = unescape(piece) if "&" in piece else piece
        self.parts.append(piece)
        if self.places.get("a"):
            self.link_chars += len(piece.strip())

    def end_line(self) -> None:
        """At the edge of a block. Those of hidden blocks only part hidden lines from each other."""
        if self.hidden:
            self.hidden_lines += self.concealed
            self.concealed = False
            return
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        own = self.stack[self.blocks[-1]].name if self.blocks else ""
        parent = self.stack[self.blocks[-2]].number if len(self.blocks) > 1 else 0
        for line in ([text] if text else []) + [""] * (self.hidden_lines + self.concealed):
            self.texts.append(line)
            self.kinds.append((parent, own))
            self.good.append((bool(line), self.depth > 0))
            self.linked.append(self.link_chars)
        self.parts.clear()
        self.hidden_lines, self.concealed, self.link_chars = 0, False, 0

    def pop(self) -> None:
        last = self.stack.pop()
        self.places[last.name].pop()
        if last.block:
            self.blocks.pop()
        if self.borders and self.borders[-1] == len(self.stack):
            self.borders.pop()
        self.hidden -= last.hides
        self.undone -= last.hides and last.undone
        self.depth -= last.article

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def close(self, name: str) -> None:
        block = name in BLOCKS
        if block:
            self.end_line()
        own = self.places.get(name)
        if not own or name in ("html", "body"):
            return
        if block or name in BOILERPLATE or not self.blocks or own[-1] > self.blocks[-1]:
            hidden = self.hidden
            self.pop_to(own[-1])
            if block and hidden:
                self.end_line()
        elif name == "a":  # a link ends where it is closed, blocks that it holds stay open
            link = self.stack[own[-1]]
            self.hidden -= link.hides
            self.undone -= link.hides and link.undone
            link.hides = False
            link.name = "#a"
            self.places.setdefault("#a", []).append(own.pop())

    def open(self, name: str, attributes: dict[str, str]) -> None:
        block = name in BLOCKS
        if block:
            self.end_line()
            closes = CLOSES.get(name, ())
            while self.blocks and name != "br" and self.stack[self.blocks[-1]].name in ("p", *closes):
                if self.borders and self.borders[-1] > self.blocks[-1]:
                    break
                self.pop_to(self.blocks[-1])
            self.end_line()
        elif name == "a" and self.places.get("a"):
            self.close("a")
        if name in VOID or (name in ("svg", "math") and "/" in attributes):
            return
        attributes.pop("/", None)
        hides, undone = _hides(name, attributes, self.depth > 0)
        article = (name in ARTICLE or attributes.get("role", "").strip().lower() == "main") and not hides
        if article and not self.found and self.undone:
            for element in self.stack:
                self.hidden -= element.hides and element.undone
                element.hides = element.hides and not element.undone
            self.undone = 0
        self.places.setdefault(name, []).append(len(self.stack))
        if block:
            self.blocks.append(len(self.stack))
        if name in BORDERS:
            self.borders.append(len(self.stack))
        self.count += 1
        self.stack.append(_Open(name, hides, undone, article, block, self.count))
        self.hidden += hides
        self.undone += hides and undone
        self.depth += article
        self.found |= article and not self.hidden


def lines(html: str) -> tuple[list[str], list[float], bool, list[tuple[int, str]]]:
    """Text and length of each line, whether the page marks its article, and the kind of each line's block."""
    page = _Lines()
    for kind, value, attributes in tokens(html):
        if kind == "text":
            page.text(value)
        elif kind == "open":
            page.open(value, attributes)
        else:
            page.close(value)
    page.hidden = 0  # what is left open hides nothing that came before
    page.end_line()
    found = page.found and any(shown and inside for shown, inside in page.good)
    lengths = []
    for text, (shown, inside), link in zip(page.texts, page.good, page.linked):
        if not shown or (found and not inside) or (not found and link > LINK_SHARE * len(text)):
            lengths.append(0.0)
        else:
            lengths.append(float(len(text)))
    return page.texts, lengths, found, page.kinds


def between_surge_and_dive(lengths: Sequence[float], threshold: float, window: int = WINDOW) -> np.ndarray:
    """Whether each line lies between a surge point and its dive point, or in the highest window if there is no surge."""
    x = np.asarray(lengths, float)
    n = len(x)
    if not n or not x.any():
        return np.zeros(n, bool)
    total = np.concatenate(([0.0], np.cumsum(x)))
    starts = np.arange(-(window - 1), n)
    sums = total[np.minimum(starts + window, n)] - total[np.maximum(starts, 0)]
    high = sums >= min(threshold, sums.max())
    inside = np.zeros(n + 1, int)
    np.add.at(inside, np.maximum(starts[high], 0), 1)
    np.add.at(inside, np.minimum(starts[high] + window, n), -1)
    return np.cumsum(inside)[:n] > 0


def grown(keep: np.ndarray, lengths: Sequence[float], kinds: Sequence[tuple[int, str]], enough: float) -> np.ndarray:
    """The text of a page that marks no article, with what belongs to it.

    Lines of `enough` characters between a surge and its dive are its core. What a window adds before the first and behind the
    last of them belongs to it only if it is of their kinds.
    """
    size = np.asarray(lengths)
    has = size > 0
    inside = keep & has
    if not inside.any():
        return keep
    core = inside & (size >= min(enough, size[inside].max()))
    names = {kind for kind, c in zip(kinds, core) if c}
    parents = {parent for parent, _ in names}
    alike = np.array([(p, n) in names or (p in parents and n in _HEADS) for p, n in kinds], bool)
    region = np.cumsum(np.diff(keep.astype(np.int8), prepend=0) == 1)
    first, last = np.full(region[-1] + 1, len(size)), np.zeros(region[-1] + 1, int)
    at = np.flatnonzero(core)
    np.minimum.at(first, region[at], at)
    np.maximum.at(last, region[at], at)
    place = np.arange(len(size))
    between = inside & (place >= first[region]) & (place <= last[region])
    more = alike & has
    for i in range(int(np.flatnonzero(between)[0]) - 1, -1, -1):
        if has[i] and not more[i] and kinds[i][1] not in _HEADS:
            break
        more[i] |= has[i]
    return between | more


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    if not html:
        return ""
    texts, lengths, found, kinds = lines(html)
    keep = between_surge_and_dive(lengths, 1 if found else surge, window)
    if not found:
        keep = grown(keep, lengths, kinds, surge / window)
    return " ".join(t for t, n, k in zip(texts, lengths, keep) if k and n)


def _extracted(pages: Sequence[str | None], window: int, surge: float) -> dict[str, list]:
    texts = [main_text(p, window, surge) for p in pages]
    return {"text": texts, "n_chars": [len(t) for t in texts]}


def extract_text(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url"), window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """`keep`, text and n_chars (code points) of each page."""
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_texts(pages, html, partial(_extracted, window=window, surge=surge), fields, keep)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
