"""Labelled pages: corpus texts set in drawn page layouts, in which every block is marked as main text or not.

A layout is drawn by a generator that the document's id seeds, from the parts that pages are made of.  data-keep="1"
marks main text and data-keep="0" what isn't; the mark is read in training alone.
"""

from __future__ import annotations

import random
from html import escape

#: Names that class and id attributes have on the web, by part.
NAMES = {
    "menu": ["nav", "menu", "main-menu", "navbar", "topnav", "navigation", "breadcrumb", "breadcrumbs", "nav-links", "toc"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-header", "branding", "topbar"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "colophon", "legal", "bottom"],
    "sidebar": ["sidebar", "side", "widget-area", "widget", "right-column", "rail", "aside", "secondary", "left-col", "sidebar-right"],
    "notice": ["cookie-notice", "notice", "cookie-banner", "alert", "gdpr", "consent", "announcement", "message", "popup", "modal", "notification", "warning"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner-ad", "sponsored", "promo", "ad-slot", "adsbygoogle", "sponsor", "banner", "ad-container"],
    "form": ["newsletter", "subscribe", "search-form", "signup", "login", "contact-form", "search"],
    "comments": ["comments", "comment-list", "commentlist", "disqus", "responses", "reader-comments", "discussion", "respond", "comments-area"],
    "comment": ["comment", "comment-body", "reply", "comment-text", "comment-content"],
    "related": ["related", "related-posts", "recommended", "more-stories", "read-next", "popular", "trending", "tags", "pagination"],
    "share": ["share", "social", "share-buttons", "social-links", "sharing"],
    "content": ["content", "post", "entry", "entry-content", "article", "article-body", "post-content", "main", "story", "text", "body", "post-body", "main-content"],
    "wrap": ["wrapper", "container", "page", "layout", "row", "inner", "site", "wrap", "grid", "columns"],
}


class Layout:
    """One drawn page."""

    def __init__(self, text: str, other: list[str], seed: int):
        self.draw, self.text, self.other = random.Random(seed), text, other or ["text"]
        self.bare = self.draw.random() < 0.15  # a page without telling names

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def words(self, least: int, most: int) -> str:
        n = self.draw.randint(least, most)
        at = self.draw.randrange(max(1, len(self.other) - n))
        return escape(" ".join(self.other[at : at + n]))

    def sentence(self, least: int, most: int) -> str:
        return self.words(least, most).rstrip(".,") + self.draw.choice("....!?")

    def named(self, part: str) -> str:
        if self.bare and part in ("content", "wrap"):
            return ""
        return f' {self.draw.choice(["class", "class", "id"])}="{self.draw.choice(NAMES[part])}"'

    def box(self, part: str, tags: str, inside: str, keep: str = "") -> str:
        """An element named by its tag or by its class, or by both."""
        tag = self.draw.choice(tags.split())
        telling = tag not in ("div", "section", "ul", "ol")
        return f"<{tag}{'' if telling and self.chance(0.5) else self.named(part)}{keep}>{inside}</{tag}>"

    def links(self, n: int, least: int = 1, most: int = 3) -> str:
        made = [f'<a href="/{i}">{self.words(least, most)}</a>' for i in range(n)]
        return f"<ul>{''.join(f'<li>{a}</li>' for a in made)}</ul>" if self.chance(0.7) else self.draw.choice([" ", " | ", ""]).join(made)

    def menu(self) -> str:
        return self.box("menu", "nav nav div div ul", self.links(self.draw.randint(2, 9)))

    def header(self) -> str:
        inside = self.draw.choice([f"<div>{self.words(1, 4)}</div>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.sentence(3, 12)}</p>", f"<h2>{self.words(1, 4)}</h2>"])
        return self.box("header", "header div", inside + (self.menu() if self.chance(0.5) else "") + (self.form() if self.chance(0.2) else ""))

    def footer(self) -> str:
        inside = self.draw.choice([
            f"&copy; {self.words(1, 3)} &middot; {self.sentence(4, 30)}", f"<p>&copy; 2020 {self.words(1, 4)}</p>{self.links(3)}", f"Copyright {self.words(1, 5)}",
            f"<p>{self.sentence(5, 25)}</p><p>{self.sentence(5, 25)}</p>", f"<div>{self.links(5)}</div>{self.words(2, 8)}",
        ])
        return self.box("footer", "footer footer div", inside)

    def widget(self) -> str:
        return f"<h3>{self.words(1, 4)}</h3>" + self.draw.choice([self.links(4, 2, 8), f"<p>{self.sentence(5, 30)}</p>", f"<div>{self.sentence(4, 20)} <a href='/'>{self.words(1, 3)}</a></div>"])

    def sidebar(self) -> str:
        return self.box("sidebar", "aside aside div", "".join(self.widget() for _ in range(self.draw.randint(1, 4))))

    def notice(self) -> str:
        inside = f"<p>{self.sentence(6, 40)} <a href='/'>{self.words(1, 2)}</a></p>" if self.chance(0.5) else self.sentence(5, 40)
        return self.box("notice", "div div section", inside, ' role="alert"' if self.chance(0.2) else "")

    def advert(self) -> str:
        inside = self.draw.choice([self.sentence(3, 40), f"<p>{self.sentence(3, 40)}</p>", f"<a href='/'>{self.words(2, 8)}</a>", f"{self.sentence(3, 20)}<p>{self.sentence(3, 30)}</p>"])
        return self.box("ad", "div div div aside", inside)

    def form(self) -> str:
        inside = f"<label>{self.words(1, 4)}</label> <input type='text'> <button>{self.words(1, 2)}</button>"
        inside = self.draw.choice([inside, f"<p>{self.sentence(4, 20)}</p>{inside}", f"<h3>{self.words(1, 4)}</h3><div>{inside}</div>"])
        return self.box("form", "form", inside) if self.chance(0.7) else f"<div{self.named('form')}><form>{inside}</form></div>"

    def comments(self) -> str:
        tag = self.draw.choice(["div", "li", "article"])
        said = [
            f"<{tag}{self.named('comment')}>" + (f"<div>{self.words(1, 2)}</div>" if self.chance(0.5) else "") + "".join(f"<p>{self.sentence(3, 60)}</p>" for _ in range(self.draw.randint(1, 3))) + f"</{tag}>"
            for _ in range(self.draw.randint(1, 8))
        ]
        inside = "".join(said)
        inside = f"<ol>{inside}</ol>" if tag == "li" else inside
        return f"<{(t := self.draw.choice(['section', 'div', 'div', 'aside']))}{self.named('comments')}>" + (f"<h2>{self.words(1, 3)}</h2>" if self.chance(0.7) else "") + inside + (self.form() if self.chance(0.4) else "") + f"</{t}>"

    def related(self) -> str:
        return self.box("related", "div section aside", f"<h3>{self.words(1, 3)}</h3>{self.links(self.draw.randint(2, 6), 2, 10)}")

    def share(self) -> str:
        return self.box("share", "div ul", self.links(self.draw.randint(2, 4), 1, 1))

    def dropped(self, made: str) -> str:
        return f'<div data-keep="0"{self.named("wrap") if self.chance(0.3) else ""}>{made}</div>' if self.chance(0.3) else made.replace(">", ' data-keep="0">', 1)

    def main(self) -> str:
        """The article: heading, paragraphs of several kinds, and now and then something between them that isn't text."""
        lines = [escape(line) for line in self.text.split("\n") if line.strip()]
        out = []
        if self.chance(0.85):
            head = f"<h1>{self.words(2, 12) if self.chance(0.5) or not lines else lines[0][:60]}</h1>"
            out.append(f"<header>{head}</header>" if self.chance(0.15) else head)
        listed = ""
        for line in lines:
            if self.chance(0.08):
                words = line.split(" ")
                at = self.draw.randrange(len(words))
                words[at] = f"<a href='/'>{words[at]}</a>"
                line = " ".join(words)
            kind = self.draw.random()
            if listed and kind > 0.6:
                out.append(f"</{listed}>")
                listed = ""
            if listed:
                out.append(f"<li>{line}</li>")
            elif kind < 0.72:
                out.append(f"<p>{line}</p>")
            elif kind < 0.82:
                out.append(f"<p><b>{line}<br>")
            elif kind < 0.88:
                out.append(f"<div>{line}</div>")
            elif kind < 0.92:
                out.append(f"<blockquote>{'<p>' if self.chance(0.5) else ''}{line}</blockquote>")
            elif kind < 0.96:
                head = self.draw.choice(["h2", "h3"])
                part = f"<{head}>{self.words(1, 8)}</{head}><p>{line}</p>"
                out.append(f"<section>{part}</section>" if self.chance(0.3) else part)
            else:
                listed = self.draw.choice(["ul", "ol"])
                out.append(f"<{listed}><li>{line}</li>")
            if not listed and self.chance(0.04):
                out.append(self.dropped(self.draw.choice([self.advert, self.advert, self.related, self.share, self.form, self.notice])()))
        if listed:
            out.append(f"</{listed}>")
        for part, p in ((self.share, 0.15), (self.related, 0.12), (self.comments, 0.1), (self.form, 0.06)):
            if self.chance(p):
                out.append(self.dropped(part()))
        return "".join(out)

    def page(self) -> str:
        keep = ' data-keep="1"'
        main = self.main()
        kind = self.draw.random()
        if kind < 0.4:
            body = f"<article{self.named('content') if self.chance(0.3) else ''}{keep}>{main}</article>"
        elif kind < 0.5:
            body = f"<main><article{keep}>{main}</article></main>"
        elif kind < 0.6:
            body = f"<main{self.named('content') if self.chance(0.3) else ''}{keep}>{main}</main>"
        elif kind < 0.95:
            body = f"<div{self.named('content')}{keep}>{main}</div>"
        else:
            body = f"<table><tr><td{keep}>{main}</td><td>{self.widget()}</td></tr></table>"
        before = [p() for p, c in ((self.notice, 0.2), (self.header, 0.5), (self.menu, 0.6), (self.advert, 0.4), (self.sidebar, 0.2)) if self.chance(c)]
        after = [p() for p, c in ((self.share, 0.1), (self.sidebar, 0.3), (self.advert, 0.15), (self.comments, 0.35), (self.related, 0.25), (self.form, 0.15), (self.footer, 0.75), (self.notice, 0.15)) if self.chance(c)]
        if self.chance(0.4):
            cut = self.draw.randint(0, len(before))
            inner = "".join(before[cut:]) + body + "".join(after[: self.draw.randint(0, len(after))])
            after = after if inner.endswith(body) else [a for a in after if a not in inner]
            body = f"<div{self.named('wrap')}>{inner}</div>"
            before = before[:cut]
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
