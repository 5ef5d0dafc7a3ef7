"""Main text of web pages by their line-block distribution.

A page is stripped of markup into lines, one per block element, in page order.  Each
line weighs as many characters as it has of running text: characters of links count
nothing, nor do lines inside elements that declare themselves something other than the
article (navigation, headers and footers of the page, asides, forms, adverts, notices,
comments), nor, on a page that declares an article, lines outside it.  The weights of
each few consecutive lines are summed; the text surges where the sums rise from nothing
over a threshold and dives where they fall back to nothing.  What stands between a surge
and its dive is the main text, without the lines that declare themselves something else.

The markup reader follows the tags alone (a stack of open elements); it takes broken
pages as they come: unclosed elements end with their parents or at the end of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

#: Lines summed at a place of the distribution.
WINDOW = 3
#: Characters of running text that a surge needs on pages that declare no article (half of
#: the page's largest sum suffices); inside a declared article any text will do.
SURGE = 80

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
                  r"""|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements whose content is no markup: it ends at the first closing tag of the name.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "noembed", "xmp", "template", "svg",
        "math", "object", "canvas", "audio", "video", "select", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
          "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
          "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: A start tag of the key ends an open element of the values, up to the nearest of ``_SCOPE``.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"article", "aside", "body", "div", "dl", "footer", "form", "header", "main", "menu", "nav", "ol", "section",
          "table", "td", "th", "ul"}
#: Elements that are something other than the article by their name ...
_OTHER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "label", "fieldset", "head", "search"}
#: ... by a role ...
_OTHER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog",
               "alertdialog", "alert", "toolbar"}
#: ... or by a word of their class or id.
_OTHER_WORD = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "sponsor",
               "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
               "sidebar", "aside", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice",
               "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
               "login", "comment", "comments", "commentlist", "disqus", "respond", "responses", "replies", "reply",
               "discussion", "related", "recommended", "recommendations", "share", "sharing", "social", "widget", "pagination", "pager", "skip",
               "copyright", "hidden", "paywall", "disclaimer"}
_HEADER_WORD = {"header", "head", "top"}
#: A class name with one of these words says what a page has, not what an element is.
_ABOUT_PAGE = {"with", "without", "has", "no"}
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(rest)}


class _Element:
    __slots__ = ("name", "other", "link", "main")

    def __init__(self, name: str, other: bool, link: bool, main: bool):
        self.name, self.other, self.link, self.main = name, other, link, main


def _element(name: str, rest: str, inside_main: bool) -> _Element:
    other, main, link = name in _OTHER, name in ("article", "main"), name == "a"
    if name == "header":  # the article's own headline may stand in one
        other = not inside_main
    if rest.strip(" /"):
        a = _attributes(rest)
        role = a.get("role", "").lower()
        names = [set(_WORD.findall(_CAMEL.sub(" ", x).lower())) for x in (*a.get("class", "").split(), a.get("id", ""))]
        words = {x for w in names if not w & _ABOUT_PAGE for x in w}
        if role in _OTHER_ROLE or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
            other = True
        elif name not in ("article", "main", "body", "html") and (
                words & _OTHER_WORD or (not inside_main and name in ("div", "section", "table") and words & _HEADER_WORD)):
            other = True
        main = main or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
        if name == "article" and words & {"comment", "comments", "related", "teaser", "promo", "ad"}:
            other, main = True, False  # readers' comments are often articles inside the article
    return _Element(name, other, link, main and not other)


class Line:
    """One block's text, its characters in links, whether it is something other than the
    article, and whether it stands in a declared article.  Inline parts that are something
    other are left out of a line that has any text besides them."""

    __slots__ = ("text", "links", "other", "main")

    def __init__(self, text: str, links: int, other: bool, main: bool):
        self.text, self.links, self.other, self.main = text, links, other, main


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, those without text left out."""
    out: list[Line] = []
    stack: list[_Element] = []
    is_open: Counter[str] = Counter()
    text: list[str] = []
    aside: list[str] = []  # of the same line, inside elements that are something other
    links = 0
    other = main = link = 0  # open elements of each kind

    def flush() -> None:
        nonlocal links
        if text or aside:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                out.append(Line(own, links, False, main > 0))
            elif rest := " ".join(html.unescape("".join(aside)).split()):
                out.append(Line(rest, 0, True, main > 0))
            text.clear()
            aside.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal other, main, link
        for e in stack[k:]:
            other, main, link = other - e.other, main - e.main, link - e.link
            is_open[e.name] -= 1
        del stack[k:]

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        piece = page[pos:m.start()] if m else page[pos:]
        if piece and other:
            aside.append(piece)
        elif piece:
            text.append(piece)
            if link:
                links += len(" ".join(html.unescape(piece).split()))
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1 if is_open[name] else -1, -1, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if stack[k].name in _SCOPE and name not in _BLOCK:
                    break  # an inline end tag reaches no further than its own block
            continue
        if name in _RAW:
            if name == "title":
                flush()
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name == "br":
                (aside if other else text).append(" ")
            continue
        if name in _BLOCK:
            flush()
            gone = _ENDS.get(name)
            for k in range(len(stack) - 1 if is_open["p"] or (gone and any(is_open[x] for x in gone)) else -1, -1, -1):
                e = stack[k].name
                if e == "p" or (gone and e in gone):
                    close(k)
                    if e == "p" and not gone:
                        break
                elif e in _SCOPE:
                    break
        rest = m[3] if m[2] else m[6]
        if rest.rstrip().endswith("/") and name not in _BLOCK:
            continue
        e = _element(name, rest, main > 0)
        stack.append(e)
        is_open[name] += 1
        other, main, link = other + e.other, main + e.main, link + e.link
    flush()
    return out


def spans_of(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Surge and dive points: [begin, end) of the lines between them.

    A sum stands for ``window`` lines from a place on.  A surge is where the sums, coming
    from nothing, pass the threshold before they are nothing again; the dive is where
    they are nothing again.  A span is trimmed to lines that weigh something.
    """
    sums = [sum(weights[i:i + window]) for i in range(len(weights))]
    out, i, n = [], 0, len(weights)
    while i < n:
        if not sums[i]:
            i += 1
            continue
        dive = i
        while dive < n and sums[dive]:
            dive += 1
        if max(sums[i:dive]) >= threshold:
            at = [k for k in range(i, dive) if weights[k]]
            out.append((at[0], at[-1] + 1))
        i = dive
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text, blocks joined by one line feed; empty if there is none."""
    lines = lines_of(page or "")
    declared = any(x.main and not x.other for x in lines)
    if declared:  # a link inside the article is article text
        weights = [len(x.text) if x.main and not x.other else 0 for x in lines]
        threshold = 1
    else:
        weights = [0 if x.other else max(len(x.text) - x.links, 0) for x in lines]
        sums = [sum(weights[i:i + window]) for i in range(len(weights))]
        threshold = max(1, min(surge, max(sums, default=0) // 2))
    return "\n".join(x.text for b, e in spans_of(weights, threshold, window) for x in lines[b:e]
                     if not x.other and (x.main or not declared))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("__html")
        texts = [main_text(pages[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "main_text"])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` plus ``main_text``.

    A null or empty page, and one without running text, has an empty main text; repeated
    rows and null ids each get their own result; an empty table gives an empty result.  A
    column of the input called ``main_text`` is replaced; others may have any name.
    """
    bound_batches(pages.sparkSession, 500, 8 << 20)
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
                     F.col(f"`{html_col}`").alias("__html"))
    schema = T.StructType([d.schema["row"], T.StructField("main_text", T.StringType())])
    out = d.mapInArrow(_extract, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in pages.columns if c != "main_text"], "main_text")


def extract_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points; edge cases as in :func:`extract`."""
    d = extract(pages.select("page_id", "url", F.col("html")))
    return d.select("page_id", "url", F.col("main_text").alias("text"),
                    F.char_length("main_text").cast("long").alias("n_chars"))
