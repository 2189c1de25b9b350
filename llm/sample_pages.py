"""Made pages with known main text, from which the block labeller learns."""

from __future__ import annotations

import random
from collections.abc import Iterator

from llm.html_blocks import Block, leaf_blocks

#: Syllables of made words: main text and the rest of a page are alike in their words.
_SYLLABLES = (
    "an at be da de el en er ga ha in is ka la le li lo ma me na ne no on or pa ra re ri ro sa se si st ta te ti to un ve "
    "ver ion ing ung que ció eau ère ñas über").split()
#: Classes and ids that sites give to the parts of a page.
_MAIN = (
    '<article>', '<main>', '<div class="content">', '<div id="content">', '<div class="post-content">', '<div class="entry">',
    '<section class="article-body">', '<div class="story">', '<div class="text body">', '<article class="post">', '<div itemprop="articleBody">',
    '<div>', '<main id="main"><article>')
_MENUS = ('<nav>', '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<nav class="breadcrumb">', '<div class="topbar">')
_HEADERS = ('<header>', '<div class="header">', '<div id="header">', '<div class="site-header">', '<div class="masthead">')
_FOOTERS = ('<footer>', '<div class="footer">', '<div id="footer">', '<div class="site-footer">', '<div class="copyright">')
_SIDES = ('<aside>', '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">', '<aside class="social share">',
          '<section class="recommended">', '<div class="tags">', '<div class="pagination">')
_ADS = ('<div class="ad">', '<div class="ads banner">', '<div class="advert">', '<div class="advertisement">', '<div id="promo">', '<div class="sponsored">',
        '<ins class="ad">', '<section class="ad-slot">')
_NOTICES = ('<div class="cookie-notice">', '<div id="consent">', '<div class="notice banner">', '<div class="modal popup">', '<div role="alert">',
            '<div class="newsletter subscribe">')
_FORMS = ('<form>', '<form class="search">', '<form class="login">', '<div class="signup"><form>')
_COMMENTS = ('<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<div class="respond reply">')


class _Maker:
    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        self.main: set[str] = set()

    def word(self) -> str:
        return "".join(self.draw.choices(_SYLLABLES, k=self.draw.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        words = [self.word() for _ in range(self.draw.randint(low, high))]
        for i in range(len(words) - 1):
            if self.draw.random() < 0.08:
                words[i] += ","
        return " ".join(words).capitalize() + self.draw.choice(("", ".", ".", ".", ".", "!", "?"))

    def prose(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.draw.randint(1, most)))

    def said(self, text: str, main: bool) -> str:
        if main:
            self.main.add(" ".join(text.split()))
        if self.draw.random() < 0.2:
            words = text.split(" ")
            at = self.draw.randrange(len(words))
            words[at] = self.draw.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>")).format(words[at])
            text = " ".join(words)
        return text

    def block(self, name: str, text: str, main: bool) -> str:
        text = self.said(text, main)
        if name == "p" and self.draw.random() < 0.15:
            return f"<p><b>{text}<br>"
        return f"<{name}>{text}" + ("" if name in ("p", "li") and self.draw.random() < 0.3 else f"</{name}>")

    def closed(self, opened: str, inner: str) -> str:
        names = [part.split()[0].strip(">") for part in opened.split("<")[1:]]
        return opened + inner + "".join(f"</{n}>" for n in reversed(names))

    def links(self, main: bool = False) -> str:
        items = []
        for _ in range(self.draw.randint(2, 8)):
            text = self.sentence(1, 3).rstrip(".!?")
            items.append(f'<li><a href="/{self.word()}">{text}</a></li>')
        return "<ul>" + "".join(items) + "</ul>"

    def article(self) -> str:
        pick, out = self.draw.random, []
        if pick() < 0.85:
            out.append(self.block(self.draw.choice(("h1", "h1", "h2")), self.sentence(1, 9), True))
        for _ in range(self.draw.randint(1, 12)):
            kind = pick()
            if kind < 0.75:
                out.append(self.block("p", self.prose(), True))
            elif kind < 0.82:
                out.append(self.block(self.draw.choice(("h2", "h3")), self.sentence(1, 6), True))
            elif kind < 0.88:
                out.append(self.closed("<ul>", "".join(self.block("li", self.sentence(), True) for _ in range(3))))
            elif kind < 0.93:
                out.append(self.closed("<blockquote>", self.block("p", self.prose(3), True)))
            elif kind < 0.96:
                out.append(self.closed(self.draw.choice(_ADS), self.loose()))
            else:
                out.append(self.closed("<table><tr>", "".join(self.block("td", self.sentence(1, 5), True) for _ in range(3))))
        return "".join(out)

    def loose(self) -> str:
        return self.said(self.prose(3), False) if self.draw.random() < 0.6 else self.block("p", self.prose(3), False)

    def comments(self) -> str:
        one = [self.closed(self.draw.choice(("<li>", '<div class="comment">')), self.block("p", self.prose(4), False)) for _ in range(self.draw.randint(1, 4))]
        return self.closed(self.draw.choice(_COMMENTS), self.block("h3", self.sentence(1, 3), False) + "".join(one))

    def page(self) -> str:
        draw, pick = self.draw, self.draw.random
        parts = []
        if pick() < 0.4:
            parts.append(self.closed(draw.choice(_HEADERS), self.said(self.sentence(1, 5), False)))
        if pick() < 0.85:
            parts.append(self.closed(draw.choice(_MENUS), self.links()))
        for kind, chance in ((_NOTICES, 0.3), (_ADS, 0.5), (_FORMS, 0.25)):
            if pick() < chance:
                parts.append(self.closed(draw.choice(kind), self.loose()))
        opened = draw.choice(_MAIN)
        around = draw.choice(("", "", '<div class="wrapper">', '<div id="page" class="container">'))
        body = self.closed(opened, self.article())
        side = self.closed(draw.choice(_SIDES), draw.choice((self.links, self.loose))()) if pick() < 0.5 else ""
        body = side + body if pick() < 0.3 else body + side
        if pick() < 0.35:
            body += self.comments()
        parts.append(self.closed(around, body) if around else body)
        for kind, chance in ((_SIDES, 0.3), (_ADS, 0.3), (_NOTICES, 0.15)):
            if pick() < chance:
                parts.append(self.closed(draw.choice(kind), self.loose()))
        if pick() < 0.85:
            parts.append(self.closed(draw.choice(_FOOTERS), "&copy; " + self.said(self.prose(3), False)))
        page = f"<!DOCTYPE html><html><head><title>{self.sentence()}</title></head><body>{''.join(parts)}</body></html>"
        return page[:draw.randint(len(page) // 2, len(page))] if pick() < 0.1 else page


def sample_pages(count: int, seed: int) -> Iterator[tuple[list[Block], list[bool]]]:
    """Blocks of ``count`` made pages, and which of them are main text. The last block of a cut page counts
    as main text if it begins one."""
    for i in range(count):
        maker = _Maker(seed * 1_000_003 + i)
        blocks = leaf_blocks(maker.page())
        yield blocks, [b.text in maker.main or (b is blocks[-1] and any(t.startswith(b.text) for t in maker.main)) for b in blocks]
