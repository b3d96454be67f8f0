"""Pages as trees of blocks: a tolerant scan of HTML into block elements and the runs of text between them.

Nodes are block elements and text runs, in page order, parents first.  Inline elements belong to the run they stand in;
scripts, styles, heads, embedded objects and form controls give no nodes.  Tags that close others by implication (p, li,
dt, dd, tr, td, th, option) do so; unmatched end tags only end the run; an unclosed comment or tag hides the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements that begin and end a block of text.
BLOCKS = set(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements whose contents are not text of the page; those of the first line hold raw text up to their end tag.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head template noscript svg math object canvas audio video select button datalist".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Where an implied end may not pass; elements between that it may.
THROUGH = {"div", "p", "address", "tbody", "thead", "tfoot", "td", "th", "dt", "dd", "li"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_NAMES = re.compile(r"""\b(class|id|role|data-keep|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Parallel lists over nodes: parent (-1 for the root), tag ("" for a text run), tokens of class, id and role, text,
    share of the text inside links, and the mark that a labelled page gives (None without one)."""

    __slots__ = ("parent", "tag", "tokens", "text", "linked", "mark")

    def __init__(self) -> None:
        self.parent, self.tag, self.tokens, self.text, self.linked, self.mark = [-1], ["root"], [()], [""], [0.0], [None]

    def add(self, parent: int, tag: str, tokens: tuple, text: str, linked: float, mark: bool | None) -> int:
        for column, value in zip((self.parent, self.tag, self.tokens, self.text, self.linked, self.mark), (parent, tag, tokens, text, linked, mark)):
            column.append(value)
        return len(self.parent) - 1


def attributes(source: str) -> tuple[tuple, bool | None]:
    """Lower-case words of class, id and role, and the mark of a labelled page."""
    tokens, mark = [], None
    for name, value in _NAMES.findall(source):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-keep":
            mark = value == "1"
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            tokens.append("hidden")
        elif name != "style":
            tokens += [w.lower() for w in _WORDS.findall(value)]
    return tuple(dict.fromkeys(tokens)), mark


def parse(html: str | None) -> Page:
    page = Page()
    html = html or ""
    size, at = len(html), 0
    stack, opened = [0], Counter()
    pieces: list[str] = []
    linked = anchor = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                page.add(top, "", (), text, min(1.0, linked / len(text)), page.mark[top])
            pieces.clear()
        linked = 0

    def pop() -> None:
        opened[page.tag[stack.pop()]] -= 1

    while at < size:
        less = html.find("<", at)
        less = size if less < 0 else less
        if less > at:
            text = unescape(html[at:less])
            pieces.append(text)
            linked += len(text) if anchor else 0
        if less == size:
            break
        if html.startswith("<!--", less):
            end = html.find("-->", less + 4)
            at = size if end < 0 else end + 3
            continue
        if html[less + 1 : less + 2] in ("!", "?"):
            end = html.find(">", less)
            at = size if end < 0 else end + 1
            continue
        found = _TAG.match(html, less)
        if not found:
            if html[less + 1 : less + 2].isalpha() or html.startswith("</", less):
                end = html.find(">", less)  # a broken tag
                at = size if end < 0 else end + 1
            else:
                pieces.append("<")
                at = less + 1
            continue
        at, closing, tag = found.end(), found.group(1), found.group(2).lower()
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = size if end is None else html.find(">", end.start()) + 1 or size
        elif tag in HIDDEN and not closing:
            at = _past(html, at, tag)
        elif tag == "a":
            anchor = 0 if closing else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            if closing:
                if opened[tag]:
                    while page.tag[stack[-1]] != tag:
                        pop()
                    pop()
                continue
            top = page.tag[stack[-1]]
            if top == "p" or (top in HEADINGS and tag in HEADINGS):
                pop()
            if tag in CLOSED_BY and any(opened[t] for t in CLOSED_BY[tag]):
                depth = len(stack) - 1
                while depth and page.tag[stack[depth]] not in CLOSED_BY[tag] and page.tag[stack[depth]] in THROUGH:
                    depth -= 1
                while depth and page.tag[stack[depth]] in CLOSED_BY[tag]:
                    while len(stack) > depth:
                        pop()
                    depth -= 1
                    if page.tag[stack[depth]] in SCOPE[tag]:
                        break
            tokens, mark = attributes(found.group(3)) if found.group(3) else ((), None)
            parent = stack[-1]
            stack.append(page.add(parent, tag, tokens, "", 0.0, page.mark[parent] if mark is None else mark))
            opened[tag] += 1
    flush()
    return page


def _past(html: str, at: int, tag: str) -> int:
    """The place after the end tag of a hidden element that begins before `at` (nested ones of its kind included); a head
    also ends where the body begins."""
    depth, pattern = 1, re.compile(rf"<(/?)({tag}|script|style{'|body' if tag == 'head' else ''})\b", re.I)
    while depth:
        found = pattern.search(html, at)
        if not found:
            return len(html)
        name = found.group(2).lower()
        if name == "body":
            return found.start()
        end = html.find(">", found.end())
        at = len(html) if end < 0 else end + 1
        if name in ("script", "style") and not found.group(1):
            close = re.compile(rf"</{name}\b", re.I).search(html, at)
            at = len(html) if close is None else html.find(">", close.start()) + 1 or len(html)
        elif name == tag:
            depth += -1 if found.group(1) else 1
    return at
