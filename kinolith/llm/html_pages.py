"""Labelled pages from templates, to train the extraction of main text on.

Each page is drawn: a layout of main text and a number of the things around it.
Pieces of main text carry MARK, which the labels are read from.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

MARK = "\ue000"
#: How often a page is cut off before its end, and an end tag is left out.
CUT, UNCLOSED = 0.12, 0.12

_SYLLABLES = "an ba che de er fo gi ha in ka lo mi na or pe qu ra si to un ve wi".split()


class Writer:
    """Text and markup of one page."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        # a page has its own style, so that the length of a text alone says little
        self.sentences, self.longest = self.rng.choice((1, 1, 2, 6)), self.rng.choice((4, 8, 20))

    def pick(self, *options):
        return self.rng.choice(options)

    def maybe(self, share: float) -> bool:
        return self.rng.random() < share

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize()

    def sentence(self, low: int = 1, high: int = 0) -> str:
        return self.words(low, high or self.longest) + self.pick(".", ".", ".", "?", "!", "")

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, min(most, self.sentences))))

    def many(self, usual: int) -> int:
        """A number of parts: usually few, at times many, so that parts alike don't outvote what is around them."""
        return self.rng.randint(1, usual if self.maybe(0.85) else usual * 20)

    def tag(self, name: str, inner: str, marks: str = "", closed: bool = True) -> str:
        key = self.pick("class", "class", "id")
        if name == "div" and self.maybe(0.05):
            marks = self.word()  # a name that says nothing
        opened = f'<{name} {key}="{marks}">' if marks and "=" not in marks else f"<{name} {marks}>" if marks else f"<{name}>"
        return f"{opened}{inner}</{name}>" if closed else f"{opened}{inner}"

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    # main text

    def paragraph(self) -> str:
        text = MARK + self.pick(self.prose, self.prose, lambda: self.sentence(1, 3))()
        if self.maybe(0.15):
            text += f" {self.link(self.words(1, 4))} {self.sentence()}"
        if self.maybe(0.15):
            text = f"<b>{text}<br>" if self.maybe(0.5) else f"<em>{text}</em>"
        return text

    def main_blocks(self, many: int) -> str:
        style = self.pick("p", "p", "p", "p", "div", "br")
        out = []
        for _ in range(many):
            kind = self.rng.random()
            if kind < 0.72:
                if style == "br":
                    out.append(f"{self.paragraph()}<br><br>")
                else:
                    out.append(self.tag(style, self.paragraph(), closed=style == "div" or not self.maybe(UNCLOSED)))
            elif kind < 0.8:
                out.append(self.tag(self.pick("h2", "h3", "h4"), MARK + self.words(1, 8)))
            elif kind < 0.87:
                items = "".join(self.tag("li", self.tag("p", MARK + self.prose(2)) if self.maybe(0.2) else MARK + self.prose(2), closed=not self.maybe(UNCLOSED)) for _ in range(self.rng.randint(2, 6)))
                out.append(self.tag(self.pick("ul", "ol"), items))
            elif kind < 0.91:
                out.append(self.tag("blockquote", self.tag("p", self.paragraph()) if self.maybe(0.5) else self.paragraph()))
            elif kind < 0.94:
                rows = "".join(self.tag("tr", "".join(self.tag("td", MARK + self.words(1, 3)) for _ in range(3))) for _ in range(self.rng.randint(2, 4)))
                out.append(self.tag("table", rows))
            elif kind < 0.97:
                out.append(self.tag("figure", f'<img src="{self.word()}.jpg">' + self.tag("figcaption", MARK + self.prose(1))))
            else:
                out.append(self.tag("pre", MARK + self.words(2, 12)))
        return "".join(out)

    def main_text(self) -> str:
        parts = []
        title = self.tag(self.pick("h1", "h1", "h2"), MARK + self.words(1, 14), self.pick("", "", "title", "entry-title", "headline"))
        if self.maybe(0.75):
            parts.append(self.tag(self.pick("header", "div"), title, self.pick("", "entry-header", "article-header")) if self.maybe(0.2) else title)
            if self.maybe(0.25):
                parts.append(self.tag(self.pick("p", "div"), MARK + f"{self.words(1, 3)}, {self.rng.randint(1, 30)} {self.word()} 20{self.rng.randint(10, 25)}", self.pick("byline", "meta", "author", "date", "")))
        blocks = self.many(9)
        for _ in range(self.pick(1, 1, 1, 2, 3)):
            parts.append(self.main_blocks(blocks))
            if self.maybe(0.35):
                parts.append(self.pick(self.advert, self.advert, self.share, self.related, self.newsletter)())
        body = "".join(parts)
        wrap = self.rng.random()
        if wrap < 0.25:
            body = self.tag("div", body, self.pick("entry-content", "post-body", "article-body", "story", "text", "content", "field-item", "itemprop=\"articleBody\"", self.word(), self.word()))
        outer = self.rng.random()
        if outer < 0.4:
            return self.tag("article", body, self.pick("", "", "", "post", "article", "hentry", "story"))
        if outer < 0.55:
            return self.tag("main", self.tag("article", body) if self.maybe(0.4) else body, self.pick("", "main", "content", 'role="main"'))
        if outer < 0.85:
            name = self.pick("content", "main-content", "post", "article", "story", "entry", "page-content", "text", "body", "primary", "", 'role="main"', self.word(), self.word())
            return self.tag(self.pick("div", "div", "section", "td"), body, name)
        return body

    # what is around it

    def menu(self) -> str:
        names = [self.link(self.words(1, 2)) for _ in range(2 + self.many(7))]
        inner = self.tag("ul", "".join(self.tag("li", n) for n in names)) if self.maybe(0.7) else self.pick(" | ", " ", "<br>").join(names)
        if self.maybe(0.1):
            return self.tag(self.pick("div", "td"), inner, self.pick("", self.word()))
        if self.maybe(0.55):
            return self.tag("nav", inner, self.pick("", "", "main-nav", "menu", "navbar"))
        return self.tag("div", inner, self.pick("nav", "navigation", "menu", "topnav", "main-menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "tags", "toc", 'role="navigation"'))

    def site_header(self) -> str:
        inner = self.tag(self.pick("h1", "h2", "div", "p"), self.link(self.words(1, 4)) if self.maybe(0.6) else self.words(1, 4), self.pick("", "logo", "site-title", "brand"))
        if self.maybe(0.5):
            inner += self.tag(self.pick("p", "div"), self.sentence(3, 9), self.pick("", "tagline", "site-description", "slogan"))
        if self.maybe(0.4):
            inner += self.menu()
        if self.maybe(0.65):
            return self.tag("header", inner, self.pick("", "site-header", "page-header", 'role="banner"'))
        return self.tag("div", inner, self.pick("header", "top", "masthead", "topbar", "site-header"))

    def footer(self) -> str:
        notice = self.pick("&copy; ", "© ", "Copyright ", "") + f"{self.word()}.example {self.pick('', '&middot; ')}{self.sentence(2, 12)}"
        inner = self.tag(self.pick("p", "div"), notice) if self.maybe(0.5) else notice
        if self.maybe(0.4):
            inner += self.tag("ul", "".join(self.tag("li", self.link(self.words(1, 3))) for _ in range(self.rng.randint(2, 6))))
        if self.maybe(0.3):
            inner += self.tag("p", self.prose(3))
        if self.maybe(0.7):
            return self.tag("footer", inner, self.pick("", "", "site-footer", 'role="contentinfo"'))
        return self.tag("div", inner, self.pick("footer", "bottom", "copyright", "site-info", "legal"))

    def sidebar(self) -> str:
        inner = "".join(self.pick(self.related, self.advert, self.newsletter, self.bio)() for _ in range(self.rng.randint(1, 3)))
        if self.maybe(0.6):
            return self.tag("aside", inner, self.pick("", "sidebar", "widget-area", 'role="complementary"'))
        return self.tag(self.pick("div", "div", "td"), inner, self.pick("sidebar", "side", "rightcol", "right-column", "widgets", "secondary"))

    def bio(self) -> str:
        return self.tag(self.pick("div", "section"), self.tag("h3", self.words(1, 3)) + self.tag("p", self.prose(2)), self.pick("widget", "about", "text-widget", "box"))

    def related(self) -> str:
        items = "".join(self.tag("li", self.link(self.words(2, 10))) for _ in range(self.rng.randint(2, 6)))
        inner = self.tag(self.pick("h2", "h3", "h4", "p"), self.words(1, 3)) + self.tag("ul", items)
        return self.tag(self.pick("div", "section", "aside"), inner, self.pick("related", "related-posts", "recommended", "more", "popular", "trending", "most-read", "see-also", "widget"))

    def advert(self) -> str:
        inner = self.pick(self.prose(2), self.link(self.sentence(3, 12)), self.tag("p", self.prose(2)), self.tag("h4", self.words(2, 5)) + self.tag("p", self.sentence()))
        return self.tag(self.pick("div", "div", "div", "section", "aside", "p"), inner, self.pick("ad", "ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsor", "sponsored", "promo", "promotion", "adbox", "commercial", "offer"))

    def notice(self) -> str:
        inner = self.tag("p", self.prose(3)) if self.maybe(0.6) else self.prose(2)
        inner += self.pick("<button>Ok</button>", self.link(self.words(1, 2)), "")
        return self.tag(self.pick("div", "div", "section", "dialog"), inner, self.pick("cookie", "cookie-notice", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "warning", "privacy", 'role="dialog"', 'role="alert"'))

    def newsletter(self) -> str:
        inner = self.tag(self.pick("p", "label", "h3", "div"), self.sentence(2, 12)) + '<input type="email"><button>Go</button>'
        if self.maybe(0.3):
            inner = self.tag("p", self.prose(2)) + inner
        form = self.tag("form", inner, self.pick("", "search", "signup"))
        return form if self.maybe(0.5) else self.tag("div", form, self.pick("newsletter", "subscribe", "subscription", "signup", "search", "login", "contact"))

    def share(self) -> str:
        return self.tag("div", " ".join(self.link(self.words(1, 1)) for _ in range(self.rng.randint(2, 5))), self.pick("share", "social", "sharing", "share-buttons", "sharedaddy", "follow"))

    def comments(self) -> str:
        style = self.pick("article", "li", "div")
        name = self.pick("comment", "comment", "reply", "comment-body", "response")
        one = lambda: self.tag(style, self.tag(self.pick("p", "div", "h4"), self.words(1, 3), self.pick("", "author", "comment-author", "meta")) + self.tag("p", self.prose(4)) + (self.link(self.words(1, 1)) if self.maybe(0.4) else ""), name)
        inner = "".join(one() for _ in range(self.many(6)))
        if style == "li":
            inner = self.tag("ol", inner, self.pick("", "comment-list", "commentlist"))
        if self.maybe(0.6):
            inner = self.tag(self.pick("h2", "h3"), self.words(1, 3)) + inner
        if self.maybe(0.4):
            inner += self.tag("form", self.tag("p", self.sentence()) + "<textarea>x</textarea>", self.pick("", "comment-form", "respond"))
        return self.tag(self.pick("section", "div", "div", "ol"), inner, self.pick("comments", "comments", "comment-section", "comments-area", "discussion", "responses", "replies", "disqus", "reader-comments", "feedback"))

    def page(self) -> str:
        around = lambda parts, share: "".join(f() for f in parts if self.maybe(share))
        above = around([self.notice], 0.25) + around([self.site_header], 0.5) + around([self.menu], 0.6) + around([self.advert, self.newsletter, self.share], 0.25)
        main = self.main_text() if self.maybe(0.97) else self.related() + self.related()
        below = around([self.share, self.related, self.menu], 0.2) + around([self.comments], 0.35) + around([self.advert, self.newsletter], 0.2)
        side = self.sidebar() if self.maybe(0.4) else ""
        shape = self.rng.random()
        if shape < 0.15:
            middle = f"<table><tr>{self.tag('td', main + below)}{self.tag('td', side) if side else ''}</tr></table>"
        elif shape < 0.5:
            inner = main + below
            middle = self.tag("div", (inner + side) if self.maybe(0.7) else side + inner, self.pick("wrapper", "container", "page", "site", "row", "layout", "main", ""))
        else:
            middle = main + below + side if self.maybe(0.8) else side + main + below
        end = around([self.footer], 0.75) + around([self.notice], 0.12)
        whole = f"{above}{middle}{end}"
        if self.maybe(0.2):
            whole = self.tag("div", whole, self.pick("page", "wrapper", "app", "root", "container"))
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><script>var a = '<p>x</p>';</script></head><body>{whole}</body></html>"


def pages(many: int, seed: int = 1, write: Callable[[int], Writer] = Writer) -> Iterator[str]:
    """Drawn pages; some end early, but not before their main text began."""
    for i in range(many):
        writer = write(seed * 1_000_003 + i)
        page = writer.page()
        if writer.maybe(CUT) and MARK in page:
            least = page.index(MARK) + 20
            page = page[: writer.rng.randint(min(least, len(page)), len(page))]
        yield page
