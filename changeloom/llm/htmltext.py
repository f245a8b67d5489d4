"""Main text of HTML pages: flat text blocks classified by a decision tree over their own and their neighbours' features.

A page is cut into a flat list of blocks at block-level tags. Each block has its word count, its link
density, the same of the blocks before and after it, and where it stands (inside a container that is
never main text by its tag, class or id, or perhaps so by a class or id that may be one of a layout;
inside an article or main element; a heading). A CART tree, trained here on the small labelled table
LABELLED, tells main text from the rest: where a block stands is an input beside the others and does
not settle it, as unmarked lists of links in an article are not main text and long text in a container
of a doubtful name is. Contents of scripts, styles, forms' controls and the head are never blocks.

Pages are read forwards once, so the time is in proportion to the page however broken its markup is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches

#: Elements whose content is not shown as text, up to their end tag.
DROPPED = {"script", "style", "noscript", "template", "svg", "textarea", "select", "button", "iframe", "object", "canvas", "audio", "video", "title", "datalist", "option", "xmp", "noembed", "noframes", "annotation", "annotation-xml"}
#: Of them, those whose content is no markup, and those that a block element ends.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {"select", "button", "datalist", "option", "svg"}
#: Elements that begin and end a block.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are never main text.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "header", "search", "fieldset"}
#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class names and ids that mark menus, notices, adverts and comments.
MARKS = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|promotions?|navs?|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|footers?|cookies?|consent|gdpr|notices?|notifications?|"
    r"popups?|modals?|overlays?|comments?|commentlist|replies|reply|disqus|discussion|respond|responses|shar(?:e|ing)|socials?|relateds?|recommend(?:ed|ations)?|newsletters?|subscri(?:be|ption)|signup|login|search|pagination|pager|toolbars?|widgets?|tags?|skip|copyright|legal|hidden)",
    re.I,
)
#: The same for page headers, which are titles inside an article.
HEADER_MARKS = re.compile(r"header|masthead|topbar", re.I)
#: Of them, words that mark nothing for sure beside other words of a name.
VAGUE = {"tag", "tags", "hidden", "side", "sidebar", "sidebars", "skip", "search", "legal", "discussion", "related", "relateds", "response", "responses"}
#: Words of names that tell a page's state or layout (no-sidebar, comments-open), anywhere and at the end.
STATES = {"no", "not", "has", "have", "with", "without", "hide", "show", "overflow"}
LAST_STATES = {"open", "opened", "closed", "enabled", "disabled", "allowed", "on", "off", "none", "free", "active", "accepted", "loaded", "ready", "sticky", "fixed"}
#: Words before a topic's name (category-cookies, tag-politics).
TOPICS = {"category", "cat", "tag", "topic", "term", "type", "format", "status", "author", "template", "keyword"}
#: Words at the end of names of a marked thing's own parts (ad-box, comments-area).
PARTS = {
    "area", "bar", "block", "body", "box", "button", "buttons", "card", "cloud", "container", "form", "frame", "group", "holder", "icons", "inner", "item", "items", "label", "labels", "link", "links",
    "list", "lists", "meta", "message", "module", "outer", "panel", "pane", "row", "section", "slot", "text", "thread", "title", "unit", "widget", "wrap", "wrapper", "zone",
}
#: How much a container is outside main text: not at all, perhaps by its name, by its name, for sure by its tag, role or style.
FREE, PERHAPS, NAMED, SURE = range(4)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)[^<>\"']*+")
_STOP = re.compile(r"[<>\"']")
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++)))?")


class Tokens:
    """Text and tags of a page in order: (text, None, False, '') or ('', tag name, whether it closes, attributes).

    A tag ends at the first `>` outside quotes, or before a `<` there; a quote that is never closed is none.
    What could begin a tag or a comment but never ends is text, but for a comment's opening, which is skipped.
    """

    def __init__(self, page: str):
        self.page, self.pos = page, 0
        self._after: dict[str, int] = {}  # where a string comes next, at or behind a place it was looked for from
        self._quotes = True

    def _next(self, what: str, start: int) -> int:
        """page.find(what, start) for places that never go back, looking at each part of the page once."""
        at = self._after.get(what, -1)
        if 0 <= at < start or what not in self._after:
            at = self._after[what] = self.page.find(what, start)
        return at

    def _end(self, at: int) -> tuple[int, int]:
        """Of a tag that goes on at `at`: where its attributes end, and where the page goes on."""
        page, start = self.page, at
        while m := _STOP.search(page, at):
            c, at = m[0], m.start()
            if c == ">":
                return at, at + 1
            if c == "<":
                return at, at
            closed = self._next(c, at + 1) if self._quotes else -1
            at = max(closed, at) + 1
        self._quotes = False  # the quotes of this page do not pair up
        at = self._next(">", start)
        return at, at + 1

    def __iter__(self) -> Iterator[tuple[str, str | None, bool, str]]:
        page, size = self.page, len(self.page)
        text = 0  # where text that is not yet given begins
        while (at := page.find("<", self.pos)) >= 0:
            if at > text:
                yield page[text:at], None, False, ""
            text = at
            end = self._next(">", at)
            if end < 0 and not page.startswith("<!--", at):
                break
            m = _TAG.match(page, at)
            if m:
                stop = m.end()
                close, self.pos = (stop, stop + 1) if page[stop : stop + 1] == ">" else self._end(stop)
                text = self.pos
                yield "", m[2].lower(), bool(m[1]), page[m.end(2) : close]
                text = self.pos
            elif page.startswith("<!--", at):
                end = self._next("-->", at + 2)
                self.pos = text = end + 3 if end >= 0 else at + 4
            elif page.startswith(("<!", "<?", "</"), at):
                self.pos = text = end + 1
            else:
                self.pos = at + 1
                yield "<", None, False, ""
                text = self.pos
        if text < size:
            yield page[text:], None, False, ""

    def closing(self, name: str) -> int:
        """Where the next end tag of that name begins, -1 if there is none."""
        key = f"</{name}"
        at = self._after.get(key, -1)
        if 0 <= at < self.pos or key not in self._after:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, self.pos)
            at = self._after[key] = m.start() if m else -1
        return at


def attributes(text: str) -> dict[str, str]:
    """Names in lower case with their values; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


#: words, link density in %, words and link density before, words and link density after, inside a
#: container that is never main text (0.5: perhaps, by its name), inside article or main (-1: beside it,
#: 0: the page has none), heading -> main text?
LABELLED = [
    # an article's paragraphs, short and long, with and without links
    (40, 0, 12, 0, 60, 0, 0, 1, 0, 1), (3, 0, 30, 0, 45, 0, 0, 1, 0, 1), (1, 0, 8, 0, 0, 0, 0, 1, 0, 1), (120, 5, 40, 0, 80, 2, 0, 1, 0, 1), (15, 40, 60, 0, 50, 0, 0, 1, 0, 1),
    (6, 100, 60, 0, 50, 0, 0, 1, 0, 1), (2, 100, 20, 0, 30, 10, 0, 1, 0, 1), (9, 0, 4, 100, 6, 0, 0, 1, 0, 1), (25, 0, 5, 0, 12, 0, 0, 1, 0, 1), (5, 0, 1, 100, 4, 0, 0, 1, 0, 1),
    (300, 0, 10, 0, 3, 0, 0, 1, 0, 1), (700, 0, 0, 0, 0, 0, 0, 1, 0, 1), (2, 0, 700, 0, 1, 0, 0, 1, 0, 1), (18, 0, 2, 0, 9, 100, 0, 1, 0, 1), (1, 0, 1, 0, 1, 0, 0, 1, 0, 1),
    (50, 30, 9, 100, 7, 60, 0, 1, 0, 1), (3, 0, 0, 0, 0, 0, 0, 1, 0, 1), (11, 0, 1, 100, 9, 0, 0, 1, 0, 1), (28, 90, 12, 0, 4, 0, 0, 1, 0, 1),
    (2, 0, 2, 100, 3, 100, 0, 1, 0, 1), (16, 0, 16, 0, 6, 0, 0, 1, 0, 1), (5, 0, 3, 100, 60, 0, 0, 1, 0, 1), (70, 0, 14, 0, 2, 100, 0, 1, 0, 1), (8, 12, 5, 0, 20, 50, 0, 1, 0, 1),
    (1, 0, 0, 0, 2, 100, 0, 1, 0, 1), (6, 0, 4, 0, 5, 50, 0, 1, 0, 1), (3, 0, 50, 0, 0, 0, 0, 1, 0, 1), (5, 100, 70, 0, 80, 0, 0, 1, 0, 1),
    # lists of links in it: tables of contents, further reading
    (4, 100, 3, 100, 5, 100, 0, 1, 0, 0), (20, 90, 5, 100, 6, 100, 0, 1, 0, 0), (1, 100, 2, 100, 1, 100, 0, 1, 0, 0), (7, 100, 9, 100, 8, 95, 0, 1, 0, 0), (3, 100, 60, 0, 4, 100, 0, 1, 0, 0), (6, 100, 4, 100, 40, 0, 0, 1, 0, 0),
    (12, 100, 10, 100, 3, 0, 0, 1, 0, 0), (5, 95, 2, 0, 6, 100, 0, 1, 0, 0), (2, 100, 3, 100, 120, 0, 0, 1, 0, 0), (9, 100, 15, 0, 7, 100, 0, 1, 0, 0), (4, 100, 6, 100, 0, 0, 0, 1, 0, 0),
    (6, 100, 30, 95, 40, 0, 0, 1, 0, 0), (5, 100, 12, 100, 60, 0, 0, 1, 0, 0), (8, 100, 25, 100, 2, 0, 0, 1, 0, 0), (3, 100, 9, 0, 5, 100, 0, 1, 0, 0), (7, 100, 45, 0, 28, 100, 0, 1, 0, 0),
    # a link that stands alone between its paragraphs
    (6, 100, 30, 0, 40, 0, 0, 1, 0, 1), (4, 100, 25, 0, 22, 10, 0, 1, 0, 1), (3, 100, 9, 0, 7, 0, 0, 1, 0, 1), (12, 100, 4, 0, 3, 0, 0, 1, 0, 1), (2, 100, 120, 0, 15, 0, 0, 1, 0, 1), (5, 100, 2, 0, 60, 0, 0, 1, 0, 1),
    # its headings
    (7, 0, 6, 0, 40, 0, 0, 1, 1, 1), (4, 0, 90, 0, 70, 0, 0, 1, 1, 1), (10, 100, 1, 100, 30, 0, 0, 1, 1, 1), (2, 0, 4, 100, 10, 0, 0, 1, 1, 1),
    # menus, footers, sidebars and adverts, in and out of the article
    (1, 100, 1, 100, 1, 100, 1, 0, 0, 0), (2, 100, 0, 0, 3, 100, 1, 0, 0, 0), (12, 0, 40, 0, 0, 0, 1, 0, 0, 0), (9, 0, 1, 100, 7, 0, 1, 0, 0, 0), (60, 0, 1, 100, 8, 0, 1, 0, 0, 0),
    (30, 10, 50, 0, 20, 0, 1, 1, 0, 0), (4, 100, 80, 0, 60, 0, 1, 1, 0, 0), (45, 0, 60, 0, 30, 0, 1, 1, 0, 0), (5, 0, 30, 0, 12, 0, 1, 1, 1, 0), (3, 0, 1, 100, 20, 0, 1, 0, 1, 0),
    (150, 0, 30, 0, 40, 0, 1, 0, 0, 0), (14, 0, 90, 0, 5, 0, 1, 0, 0, 0), (8, 50, 12, 0, 4, 100, 1, 0, 0, 0), (80, 2, 60, 0, 90, 0, 1, 1, 0, 0), (1, 0, 2, 0, 1, 0, 1, 1, 0, 0),
    # comments, notices and the like of pages without article
    (40, 0, 12, 0, 60, 0, 1, 0, 0, 0), (25, 0, 45, 0, 30, 0, 1, 0, 0, 0), (1, 0, 40, 0, 35, 0, 1, 0, 1, 0), (70, 0, 1, 0, 25, 0, 1, 0, 0, 0), (22, 5, 70, 0, 2, 0, 1, 0, 0, 0), (50, 0, 0, 0, 0, 0, 1, 0, 0, 0), (18, 0, 6, 0, 40, 0, 1, 0, 0, 0),
    (33, 0, 33, 0, 33, 0, 1, 0, 0, 0), (120, 0, 22, 0, 60, 0, 1, 0, 0, 0), (28, 20, 50, 0, 8, 100, 1, 0, 0, 0), (9, 0, 30, 0, 28, 0, 1, 0, 0, 0), (65, 0, 90, 0, 80, 0, 1, 0, 0, 0), (24, 0, 3, 100, 45, 0, 1, 0, 0, 0),
    # anything beside an article
    (1, 0, 90, 0, 0, 0, 0, -1, 0, 0), (12, 0, 40, 0, 5, 0, 0, -1, 0, 0), (60, 0, 3, 100, 12, 0, 0, -1, 0, 0), (4, 100, 50, 0, 3, 100, 0, -1, 0, 0), (90, 5, 80, 0, 70, 0, 0, -1, 0, 0), (5, 0, 0, 0, 60, 0, 0, -1, 1, 0),
    (25, 0, 2, 0, 8, 0, 0, -1, 0, 0), (40, 10, 100, 0, 0, 0, 0, -1, 0, 0), (2, 0, 30, 0, 40, 0, 0, -1, 0, 0), (7, 0, 45, 0, 60, 0, 0, -1, 1, 0),
    # pages without article or main: long text with few links, and short text between such
    (45, 0, 8, 0, 70, 5, 0, 0, 0, 1), (90, 10, 50, 0, 60, 0, 0, 0, 0, 1), (30, 0, 4, 0, 35, 0, 0, 0, 0, 1), (22, 0, 40, 0, 2, 100, 0, 0, 0, 1), (60, 20, 3, 100, 40, 0, 0, 0, 0, 1),
    (5, 0, 60, 0, 55, 0, 0, 0, 0, 1), (8, 0, 40, 10, 45, 0, 0, 0, 0, 1), (12, 0, 35, 0, 30, 0, 0, 0, 0, 1), (26, 0, 2, 100, 3, 100, 0, 0, 0, 1), (40, 0, 0, 0, 0, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 0, 0, 0, 0, 1), (9, 0, 0, 0, 0, 0, 0, 0, 0, 1), (15, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (6, 0, 3, 100, 50, 0, 0, 0, 1, 1), (4, 0, 45, 0, 60, 0, 0, 0, 1, 1), (9, 0, 0, 0, 80, 0, 0, 0, 1, 1), (7, 0, 2, 100, 25, 0, 0, 0, 1, 1),
    # and link lists, bylines and leftovers around it
    (3, 100, 2, 100, 4, 100, 0, 0, 0, 0), (20, 90, 5, 100, 6, 100, 0, 0, 0, 0), (4, 0, 2, 100, 3, 100, 0, 0, 0, 0), (2, 0, 5, 0, 3, 0, 0, 0, 0, 0), (8, 80, 60, 0, 5, 100, 0, 0, 0, 0),
    (3, 0, 1, 100, 2, 0, 0, 0, 1, 0), (2, 0, 4, 100, 3, 100, 0, 0, 1, 0), (15, 100, 50, 0, 60, 0, 0, 0, 0, 0), (6, 0, 4, 0, 5, 50, 0, 0, 0, 0), (9, 0, 3, 100, 2, 0, 0, 0, 0, 0),
    (35, 85, 40, 90, 20, 100, 0, 0, 0, 0), (5, 100, 70, 0, 80, 0, 0, 0, 0, 0), (3, 0, 50, 0, 0, 0, 0, 0, 0, 0), (6, 0, 40, 0, 4, 100, 0, 0, 0, 0), (1, 0, 0, 0, 2, 100, 0, 0, 0, 0),
    (1, 100, 1, 100, 3, 0, 0, 0, 0, 0), (1, 100, 2, 100, 8, 0, 0, 0, 0, 0), (2, 100, 3, 100, 30, 0, 0, 0, 0, 0), (2, 100, 90, 0, 1, 100, 0, 0, 0, 0), (2, 100, 60, 0, 0, 0, 0, 0, 0, 0), (1, 100, 2, 100, 0, 0, 0, 0, 0, 0),
    (1, 100, 0, 0, 1, 100, 0, 0, 0, 0), (1, 100, 1, 100, 1, 100, 0, 0, 0, 0), (1, 100, 25, 0, 0, 0, 0, 0, 0, 0), (3, 100, 2, 100, 2, 0, 0, 0, 0, 0),
    # containers with a name that may be one of a layout: text of a page
    (45, 0, 8, 0, 70, 5, 0.5, 0, 0, 1), (90, 10, 50, 0, 60, 0, 0.5, 0, 0, 1), (30, 0, 4, 0, 35, 0, 0.5, 0, 0, 1), (22, 0, 40, 0, 2, 100, 0.5, 0, 0, 1), (5, 0, 60, 0, 55, 0, 0.5, 0, 0, 1), (40, 0, 0, 0, 0, 0, 0.5, 0, 0, 1),
    (12, 0, 35, 0, 30, 0, 0.5, 0, 0, 1), (26, 0, 2, 100, 3, 100, 0.5, 0, 0, 1), (6, 0, 3, 100, 50, 0, 0.5, 0, 1, 1), (4, 0, 45, 0, 60, 0, 0.5, 0, 1, 1), (9, 0, 0, 0, 80, 0, 0.5, 0, 1, 1),
    (40, 0, 30, 0, 45, 0, 0.5, 1, 0, 1), (90, 5, 40, 0, 60, 0, 0.5, 1, 0, 1), (25, 0, 5, 0, 50, 0, 0.5, 1, 0, 1), (5, 0, 60, 0, 55, 0, 0.5, 1, 0, 1), (8, 0, 40, 0, 45, 0, 0.5, 1, 0, 1), (300, 0, 10, 0, 3, 0, 0.5, 1, 0, 1),
    (4, 0, 60, 0, 70, 0, 0.5, 1, 1, 1), (22, 0, 30, 0, 2, 100, 0.5, 1, 0, 1), (7, 0, 6, 0, 40, 0, 0.5, 1, 1, 1),
    # and link lists, labels and notices
    (3, 100, 2, 100, 4, 100, 0.5, 0, 0, 0), (20, 90, 5, 100, 6, 100, 0.5, 0, 0, 0), (4, 0, 2, 100, 3, 100, 0.5, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0.5, 0, 0, 0), (15, 100, 50, 0, 60, 0, 0.5, 0, 0, 0), (5, 100, 70, 0, 80, 0, 0.5, 0, 0, 0),
    (3, 0, 50, 0, 0, 0, 0.5, 0, 0, 0), (6, 0, 40, 0, 4, 100, 0.5, 0, 0, 0), (35, 85, 40, 90, 20, 100, 0.5, 0, 0, 0), (2, 0, 4, 100, 3, 100, 0.5, 0, 1, 0), (9, 0, 3, 100, 2, 0, 0.5, 0, 0, 0),
    (3, 0, 60, 0, 2, 100, 0.5, 1, 0, 0), (4, 100, 80, 0, 60, 0, 0.5, 1, 0, 0), (6, 80, 60, 0, 50, 0, 0.5, 1, 0, 0), (12, 90, 40, 0, 30, 0, 0.5, 1, 0, 0), (2, 0, 60, 0, 0, 0, 0.5, 1, 0, 0), (20, 90, 5, 100, 6, 100, 0.5, 1, 0, 0),
    (40, 0, 12, 0, 60, 0, 0.5, -1, 0, 0), (4, 100, 50, 0, 3, 100, 0.5, -1, 0, 0), (5, 0, 0, 0, 60, 0, 0.5, -1, 1, 0),
]


class Tree:
    """A CART tree by Gini impurity, grown until the leaves are pure or `depth` is reached."""

    def __init__(self, rows: list[tuple], depth: int = 8):
        table = np.array(rows, float)
        self.root = self._grow(table[:, :-1], table[:, -1], depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = y.mean()
        if depth == 0 or share in (0, 1):
            return bool(share >= 0.5)
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] < cut
                n = left.sum()
                a, b = y[left].mean(), y[~left].mean()
                gini = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or gini < best[0] - 1e-12:
                    best = gini, f, cut, left
        if best is None:
            return bool(share >= 0.5)
        _, f, cut, left = best
        return f, cut, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)

        def walk(node, at):
            if isinstance(node, bool):
                out[at] = node
            elif len(at):
                f, cut, left, right = node
                low = x[at, f] < cut
                walk(left, at[low])
                walk(right, at[~low])

        walk(self.root, np.arange(len(x)))
        return out


def _name_mark(name: str, marks: re.Pattern, paragraph: bool = False) -> int:
    """FREE, PERHAPS or NAMED, by one class or id; a vague word alone tells less of a paragraph than of a container."""
    parts = [p for p in re.split(r"[-_]+", _CAMEL.sub("-", name).lower()) if p]
    if marks.fullmatch("".join(parts)):
        return PERHAPS if paragraph and VAGUE.issuperset(parts) else NAMED
    parts = [p for p in parts if not p[0].isdigit()]  # comment-12
    found = [p for p in parts if marks.fullmatch(p)]
    if not found or STATES.intersection(parts) or parts[-1] in LAST_STATES:
        return FREE
    vague = VAGUE.issuperset(found)
    if parts[-1] in PARTS:
        return PERHAPS if "content" in parts or "main" in parts else NAMED
    if parts[0] in TOPICS and len(parts) > 1:
        return FREE
    return NAMED if not vague and parts[-1] in found else PERHAPS


@lru_cache(4096)
def name_mark(names: str, header: bool, paragraph: bool = False) -> int:
    """How much the classes and ids (apart by white space) tell that a container is outside main text; `header`: page headers count."""
    each = names.split()
    level = max([_name_mark(n, MARKS, paragraph) for n in each if n != "hidden"], default=FREE)
    if "hidden" in each:  # hidden md:block is shown on larger screens
        level = max(level, PERHAPS if ":" in names else NAMED)
    return max(level, max([_name_mark(n, HEADER_MARKS) for n in each], default=FREE)) if header else level


def blocks(page: str) -> Iterator[tuple[str, int, int, float, bool, bool]]:
    """(text, words, words in links, never main text (0, 0.5, 1), in article or main, heading) of each block with text, in page order.

    Names never mark html, body and main, nor an article that is in no other and in no marked container.
    Where nothing else is left of a page without article, names only tell that a container is perhaps outside.
    An element of DROPPED without an end tag hides nothing, but for scripts and styles, which go on to the page's end;
    one of INLINE ends with the block it is in. Character references do not reach over tags.
    """
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open block elements, how much they are outside main text, whether they hold it
    opened: dict[str, int] = {}  # how many of each name are on the stack
    inside = articles = 0  # open article and main elements that hold main text; the articles of them
    outside = [[0] * 4]  # open elements by how much they are outside main text, by article level
    link = head = alone = 0
    hidden = ""  # an open element of DROPPED
    found: list[tuple] = []
    tokens = Tokens(page)

    def level() -> int:
        return max(k for k in range(4) if k == FREE or outside[-1][k])

    def flush():
        nonlocal alone
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                found.append((text, n, min(n, len(" ".join(linked).split())), max(level(), alone), inside > 0, head > 0))
        parts.clear()
        linked.clear()
        alone = FREE

    for text, name, closing, more in tokens:
        if name is None:
            if not hidden:
                text = html.unescape(text)
                parts.append(text)
                if link:
                    linked.append(text)
            continue
        if hidden:
            if closing and name == hidden:
                hidden = ""
                continue
            if hidden not in INLINE or name not in BLOCK:
                continue
            hidden = ""
        if name in DROPPED:
            if not closing and not more.rstrip().endswith("/"):
                stop = tokens.closing(name)
                if name in RAW and (stop >= 0 or name in ("script", "style")):
                    tokens.pos = stop if stop >= 0 else len(page)
                elif stop >= 0:
                    hidden = name
            continue
        if name == "a":
            link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            link = 0
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                head = 0 if closing else 1
            if name in VOID or name in ("p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
                if name in ("p", "li", "td", "div"):
                    head = 0
                if closing or name in VOID or name != "p" and name != "li":
                    continue
                # a paragraph or item that is marked stands alone until the next block
            if not closing:
                attrs = attributes(more) if more.strip() else {}
                holds = name in ("html", "body", "main") or name == "article" and not articles and level() < NAMED
                mark = FREE if holds else name_mark(f"{attrs.get('class', '')} {attrs.get('id', '')}", not inside, name in ("p", "li"))
                if name not in ("html", "body") and (attrs.get("role", "").strip() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog") or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "")):
                    mark = SURE
                if name in ("p", "li"):
                    alone = mark
                    continue
                main = name in ("article", "main") and mark < NAMED
                # the header of an article holds its title
                if name in OUTSIDE and not (name == "header" and inside):
                    mark = SURE
                stack.append((name, mark, main))
                opened[name] = opened.get(name, 0) + 1
                if main:
                    inside += 1
                    articles += name == "article"
                    outside.append([0] * 4)
                outside[-1][mark] += 1
            elif opened.get(name):
                while stack:
                    top, mark, main = stack.pop()
                    opened[top] -= 1
                    if main:
                        inside -= 1
                        articles -= top == "article"
                        outside.pop()
                    else:
                        outside[-1][mark] -= 1
                    if top == name:
                        break
    flush()
    named = NAMED if any(b[3] == FREE or b[4] for b in found) else SURE  # names from here on tell it for sure
    yield from [(*b[:3], 0.0 if b[3] == FREE else 1.0 if b[3] >= named else 0.5, *b[4:]) for b in found]


def page_features(found: list[tuple]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, 9))
    if n:
        x[:, 0] = [b[1] for b in found]
        x[:, 1] = [100 * b[2] / b[1] for b in found]
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
        x[:, 6:] = [b[3:] for b in found]
        if x[:, 7].any():
            x[:, 7] = 2 * x[:, 7] - 1
    return x


class Extractor:
    def __init__(self, labelled: list[tuple] = LABELLED):
        self.tree = Tree(labelled)

    def texts(self, pages: list[str | None]) -> list[str]:
        every = [list(blocks(p)) if p else [] for p in pages]
        keep = iter(self.tree.predict(np.concatenate([page_features(b) for b in every])) if pages else [])
        return [" ".join([b[0] for b, ok in zip(found, [next(keep) for _ in found], strict=True) if ok]) for found in every]


def extract(pages: DataFrame, id_col: str = "page_id", labelled: list[tuple] = LABELLED) -> DataFrame:
    """pages (id_col, url, html, ...) -> (id_col, url, text string), a row for each row of pages.

    text is the main text's blocks in page order, joined by a space, character references decoded and
    white space inside a block turned into one space; empty if there is none or html is null or empty. Whole
    pages are read, whatever their size; pages without id and repeated ones are pages like any other. Other
    columns are ignored, whatever their names.
    """
    model = Extractor(labelled)
    kind = pages.select(id_col, "url").schema.add("text", "string")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = model.texts(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("url"), pa.array(texts, pa.string())], [id_col, "url", "text"])

    return bound_batches(pages).select(id_col, "url", F.col("html").cast("string").alias("html")).mapInArrow(run, kind)
