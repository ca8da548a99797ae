"""Labelled pages for training: many layouts, each block known to be main text or frame."""

from __future__ import annotations

import random

# Names that pages commonly give to the parts of a layout.
MAIN_NAMES = [
    "content", "main", "article", "post", "entry", "story", "body", "text", "article-body", "post-content",
    "entry-content", "page-content", "main-content", "story-body", "post-body", "article__content",
]
FRAME_NAMES = [
    "nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "topbar", "logo",
    "site-header", "footer", "site-footer", "copyright", "legal", "sidebar", "side", "rail", "widget", "aside", "related",
    "recommended", "popular", "trending", "ad", "ads", "advert", "advertisement", "ad-slot", "sponsor", "sponsored",
    "promo", "cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe",
    "signup", "social", "share", "sharing", "tags", "comment", "comments", "comment-list", "reply", "replies",
    "discussion", "disqus", "respond", "author-bio", "pagination", "pager", "search", "search-form", "login", "form",
    "skip-link", "toolbar",
]
FRAME_TAGS = [
    "nav", "header", "footer", "aside", "form",
]
_SYLLABLES = [
    "an", "be", "co", "da", "en", "fi", "ga", "ho", "in", "jo", "ka", "lo", "ma", "ne", "or", "pa", "qui", "ra", "st",
    "ti", "un", "ve", "wo", "za", "tion", "ment", "er", "ly",
]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.gold: list[str] = []

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = []
        for i in range(n):
            w = "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3)))
            w = w.capitalize() if i == 0 or self.r.random() < 0.06 else w
            out.append(w + self.r.choice(["", "", "", "", "", ",", "."]))
        return " ".join(out).rstrip(",.") + self.r.choice([".", ".", "", "!"])

    def main(self, tag: str, text: str) -> str:
        self.gold.append(" ".join(text.split()))
        body = text
        if self.r.random() < 0.2:
            body = f"<b>{text}</b>"
        return f"<{tag}>{body}</{tag}>" if self.r.random() < 0.9 or tag != "p" else f"<{tag}>{body}"

    def links(self) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 2)}</a></li>' for i in range(self.r.randint(2, 8)))

    def frame(self) -> str:
        """A part that is no main text, by its tag, its name or both."""
        name, kind = self.r.choice(FRAME_NAMES), self.r.random()
        named = f'class="{name}"' if self.r.random() < 0.7 else f'id="{name}"'
        tag = self.r.choice(["div", "section", "ul", "p", "div"])
        body = self.r.choice(
            [
                f"<ul>{self.links()}</ul>",
                self.words(1, 12),
                f"<p>{self.words(4, 60)}</p>",
                f"<h3>{self.words(1, 4)}</h3><p>{self.words(5, 40)}</p>",
                f"<div><p>{self.words(10, 80)}</p><p>{self.words(5, 30)}</p></div>",
                f"&copy; {self.words(1, 3)} &middot; {self.words(2, 9)}",
                f"<label>{self.words(1, 3)}</label><button>{self.words(1, 2)}</button>",
            ]
        )
        if kind < 0.35:
            tag = self.r.choice(FRAME_TAGS)
            return f"<{tag}>{body}</{tag}>"
        if tag in ("ul", "p"):
            tag = "div"
        return f"<{tag} {named}>{body}</{tag}>"

    def body(self) -> str:
        parts = [self.main(self.r.choice(["h1", "h1", "h2"]), self.words(3, 12))] if self.r.random() < 0.85 else []
        for _ in range(self.r.randint(1, 12)):
            kind = self.r.random()
            if kind < 0.62:
                parts.append(self.main("p", self.words(1, 120)))
            elif kind < 0.70:
                parts.append(self.main(self.r.choice(["h2", "h3"]), self.words(1, 8)))
            elif kind < 0.78:
                parts.append("<ul>" + "".join(self.main("li", self.words(1, 15)) for _ in range(self.r.randint(2, 4))) + "</ul>")
            elif kind < 0.84:
                parts.append(self.main(self.r.choice(["blockquote", "pre", "figcaption", "td"]), self.words(4, 30)))
            else:
                parts.append(self.frame())
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        name = r.choice(MAIN_NAMES)
        wrap = r.choice(
            [
                ("<article>", "</article>"),
                ("<main>", "</main>"),
                ("<main><article>", "</article></main>"),
                (f'<div class="{name}">', "</div>"),
                (f'<div id="{name}">', "</div>"),
                (f'<article class="{name}">', "</article>"),
                (f'<div class="wrapper"><section class="{name}">', "</section></div>"),
                ('<div class="container"><div class="row">', "</div></div>"),
            ]
        )
        before = "".join(self.frame() for _ in range(r.randint(0, 4)))
        main = wrap[0] + self.body() + wrap[1]
        after = "".join(self.frame() for _ in range(r.randint(0, 4)))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{before}{main}{after}</body></html>"


def labelled_pages(count: int, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, main text blocks) of ``count`` pages."""
    out = []
    for i in range(count):
        maker = _Maker(seed * 100_003 + i)
        page = maker.page()
        out.append((page, maker.gold))
    return out
