"""Operator 4: main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line inside a menu, header,
footer, sidebar, notice, advert, form, comment section or the like weighs nothing; the
others weigh their text length. A part that only its class, id or role calls so is a layout
wrapper, and no noise, if it holds (or is) a marked container with a fair share of the largest
one's text, or half of the page's text. The weights are summed over sliding windows of lines; the
text begins where a window's sum surges and ends where it dives.

If the page marks its article (article, main, or a named container), the marks choose the
lines and the windows do not: every line of all containers of the best rank (article, then
main, then names) is kept, and of the other containers that neither hold nor lie in one of
those. Lines outside weigh nothing. An unmarked page needs windows over a threshold.

Defined results: NULL and empty pages give the empty string; unclosed elements end with
their parent or the page; white space inside a block becomes one space; blocks without
text are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from staylens.llm.common import annotate, free_name

WINDOW = 3
#: Characters in a window at which text surges on a page without a marked article.
SURGE = 120
#: A part called noise is a wrapper if it holds so much of the page's text, or a container
#: with so much of the largest container's text.
HALF, FAIR = 0.5, 0.25

# HTML elements and the words of class, id and role names that mark parts.
_SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head",
            "annotation", "annotation-xml", "audio", "video", "select", "textarea", "title"}
_BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div",
           "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
           "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
           "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSED = {"script", "style"}  # never self-closing
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored",
          "promo", "promotion", "sidebar", "sidenav", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
          "header", "masthead", "topbar", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
          "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
          "comment", "comments", "disqus", "replies", "respond", "related", "recommended", "recommendations",
          "share", "sharing", "social", "toolbar", "pagination", "pager", "widget", "search", "skip", "copyright",
          "disclaimer", "contentinfo", "complementary"}
_REPLIES = {"comment", "comments", "disqus", "replies", "respond"}
_CONTAINERS = {"article", "content", "post", "entry", "story", "main", "maincontent", "articlebody"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.DOTALL)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Line:
    """A block's text; ``noise``: it lies in a part that is no article text; ``inside``:
    the numbers of the marked containers around it; ``named``: the numbers of the parts
    around it that a name calls noise."""

    text: str
    noise: bool
    inside: tuple[int, ...]
    named: tuple[int, ...] = ()


@dataclass
class Named:
    """A part that a class, id or role word calls noise; ``boxes``: containers it holds or is."""

    replies: bool
    boxes: list[int]
    in_article: bool


def _marks(attrs: str) -> tuple[set[str], set[str], set[str]]:
    """Words of the class, id and role names; whole names of class and role; whole ids."""
    words: set[str] = set()
    names: set[str] = set()
    ids: set[str] = set()
    for m in _NAMES.finditer(attrs):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]
        for token in value.split():
            if not token.startswith(("has-", "with-", "no-", "is-")):  # say what is around or not
                words.update(w.lower() for w in _WORD.findall(token))
                (ids if m[1].lower() == "id" else names).add(token.lower())
    return words, names, ids


def _noise_words(name: str, marks: tuple[set[str], set[str], set[str]], in_article: bool) -> set[str]:
    """The words by which an element may be called noise. Ids of headings and paragraphs are
    anchors, their classes count as whole names; inside a marked article a class or id made of
    several words names a part of the text, so whole names alone count there."""
    words, names, ids = marks
    if name in _HEADINGS or name == "p":
        return names & _NOISE
    if in_article and name == "section":
        return (names | ids) & _NOISE
    return words & _NOISE


def lines_of(page: str) -> tuple[list[Line], list[int]]:
    """The blocks of a page, and the rank of each container (article before names)."""
    lines: list[Line] = []
    ranks: list[int] = []
    named: list[Named] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # element, noise, article's own head, container, named part
    parts: list[str] = []
    noise = own_heads = 0  # open noise elements, and those that are an article's own head
    parts_open: list[tuple[int, bool]] = []  # open named parts, and whether they are such heads
    opened: Counter[str] = Counter()  # open elements by name
    inside: list[int] = []  # open containers
    articles: list[int] = []  # those that are articles

    def end_line() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                head = any(e[0] in _HEADINGS for e in stack[-3:])
                lines.append(Line(text, noise > (own_heads if head else 0), tuple(inside),
                                  tuple(k for k, own in parts_open if not (own and head))))

    def pop() -> None:
        nonlocal noise, own_heads
        name, noisy, own_head, box, part = stack.pop()
        opened[name] -= 1
        noise -= noisy
        own_heads -= noisy and own_head
        if part >= 0:
            parts_open.pop()
        if box >= 0:
            inside.pop()
            if articles and articles[-1] == box:
                articles.pop()

    at, skip = 0, None
    while at < len(page):
        if skip:
            m = re.compile(rf"</{skip}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at, skip = (m.end() if m else len(page)), None
            continue
        m = _TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        parts.append(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                parts.append(m["cdata"])
            continue
        name = name.lower()
        if m["close"]:
            if name in _BLOCKS:
                end_line()
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _SKIPPED:
            if name == "head":  # without a close, the body ends it
                m2 = re.compile(r"</head\b[^>]*>|(?=<body\b)", re.IGNORECASE).search(page, at)
                at = m2.end() if m2 else at
            elif name in _CLOSED or not m["attrs"].rstrip().endswith("/"):
                skip = name
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCKS:
            end_line()
            if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                pop()
            if stack and name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
                pop()
        if name in _VOID or name not in _BLOCKS and m["attrs"].rstrip().endswith("/"):
            if name == "img" or name == "input":
                parts.append(" ")
            continue
        named_by = _marks(m["attrs"]) if m["attrs"] else (set(), set(), set())
        marks = named_by[0]
        wide = name in ("html", "body", "main")
        replies = bool(marks & _REPLIES)
        noisy = name in _BOILERPLATE or name == "article" and bool(marks & {"comment", "comments"})
        part = -1
        in_article = bool(articles)
        if not noisy and not wide and name != "article" and marks and _noise_words(name, named_by, in_article):
            part = len(named)
            named.append(Named(replies, [], in_article))
        own_head = (noisy or part >= 0) and bool(inside) and (name == "header" or "header" in marks)
        box = -1
        if not noisy and not noise:
            if name == "article" or "articlebody" in marks or {"article", "body"} <= marks:
                box = 0
            elif name == "main" or "main" in marks and name != "body":
                box = 1
            elif name in ("div", "section", "td") and marks & _CONTAINERS and not replies:
                box = 2
            if box >= 0:
                for k, _ in parts_open:
                    if not named[k].in_article and not (named[k].replies and box == 2):
                        named[k].boxes.append(len(ranks))
                if part >= 0:
                    named[part].boxes.append(len(ranks))
                ranks.append(box)
                if box == 0:
                    articles.append(len(ranks) - 1)
                box = len(ranks) - 1
                inside.append(box)
        noise += noisy
        own_heads += noisy and own_head
        if part >= 0:
            parts_open.append((part, own_head))
        opened[name] += 1
        stack.append((name, noisy, own_head, box, part))
    end_line()
    _settle(lines, named)
    return lines, ranks


def _settle(lines: list[Line], named: list[Named]) -> None:
    """Marks the lines of parts called noise as noise, but for layout wrappers: parts that
    hold a container with a fair share of the largest one's text, or half of the page's."""
    if not named:
        return
    boxes: dict[int, int] = {}
    parts: dict[int, int] = {}
    total = 0
    for x in lines:
        if not x.noise:
            total += len(x.text)
            for k in x.inside:
                boxes[k] = boxes.get(k, 0) + len(x.text)
            for k in x.named:
                parts[k] = parts.get(k, 0) + len(x.text)
    most = max(boxes.values(), default=0)
    wrappers = {k for k, part in enumerate(named)
                if not part.replies and parts.get(k, 0) >= HALF * total
                or any(boxes.get(i, 0) >= max(1, FAIR * most) for i in part.boxes)}
    for x in lines:
        x.noise = x.noise or any(k not in wrappers for k in x.named)


def surge_and_dive(weights: list[int], threshold: int, window: int = WINDOW) -> tuple[int, int]:
    """First and last line (end exclusive) of the text: from the first line whose window
    rises over the threshold to the last one before its final fall. (0, 0) if none does."""
    half = window // 2
    over = [i for i in range(len(weights))
            if sum(weights[max(0, i - half):i + half + 1]) > threshold]
    return (over[0], over[-1] + 1) if over else (0, 0)


def main_text(page: str) -> str:
    """The article of a page: its blocks, one a line."""
    lines, ranks = lines_of(page)
    good = [x for x in lines if not x.noise]
    held = {k for x in good for k in x.inside}
    if held:  # all marked containers of the best rank, and those beside them
        best = min(ranks[k] for k in held)
        over = {k for x in good if any(ranks[j] == best for j in x.inside) for k in x.inside}
        boxes = {k for k in held if ranks[k] == best or k not in over}
        good = [x for x in good if not boxes.isdisjoint(x.inside)]
        threshold = 0
    else:
        threshold = min(SURGE, max((len(x.text) for x in good), default=1) - 1)
    first, last = surge_and_dive([len(x.text) for x in good], threshold)
    return "\n".join(x.text for x in good[first:last])


def extract(pages: DataFrame, source: str = "html", keep=None):
    """(table, name): ``keep`` columns and a struct text, n_chars, n_lines of each page."""
    name = free_name("main_", pages)

    def work(page: str):
        text = main_text(page)
        return text, len(text), text.count("\n") + 1 if text else 0

    out = annotate(pages, source, name, "text string, n_chars bigint, n_lines bigint",
                   lambda: lambda ps: [work(p) for p in ps], keep=keep, binary=False)
    return out, name
