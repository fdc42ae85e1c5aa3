"""Made-up pages with known main text, to train the block labeller on.

A block of main text begins with MARK. Words are drawn from random syllables, so that what can be
learnt is the structure: tags, classes, lengths, links, the words of buttons and notices, and the
order of blocks.
"""

from __future__ import annotations

import random
import re

MARK = "\ue000"

_SYLLABLES = [a + b + c for a in "bcdfghklmnprstvwz" for b in "aeiou" for c in ("", "", "n", "r", "s")]
_CLASSES = {
    "nav": ("nav", "navbar", "menu", "navigation", "main-menu", "topnav", "links"),
    "header": ("header", "site-header", "masthead", "top", "topbar", "branding"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "foot", "colophon"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "adbox", "sponsor"),
    "side": ("sidebar", "side", "widget", "related", "recommended", "popular", "trending", "rail", "more-stories", "aside"),
    "notice": ("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "banner-notice", "paywall", "cookie-banner"),
    "comments": ("comments", "comment-list", "discussion", "replies", "responses", "reader-comments", "comment-section", "disqus"),
    "comment": ("comment", "reply", "comment-body", "response", "user-comment", "comment-item"),
    "form": ("search", "login", "newsletter", "subscribe", "signup", "contact", "subscribe-box", "form"),
    "share": ("share", "social", "sharing", "share-buttons", "tags", "breadcrumb", "breadcrumbs", "pagination", "pager"),
    "main": ("content", "post", "entry", "entry-content", "article", "article-body", "story", "text", "main-content", "post-body", "page", "body", "main"),
    "plain": ("row", "wrap", "container", "inner", "col", "block", "box", "section", "wrapper", "grid"),
}
_SMALL = {
    "notice": ("We use cookies to improve this site.", "Accept all cookies", "Nous utilisons des cookies.", "Wir verwenden Cookies.", "Usamos cookies.", "Accept", "Subscribe to read more", "OK"),
    "form": ("Search", "Log in", "Subscribe", "Your email address", "Sign up for our newsletter", "Send", "Password", "Suche", "Rechercher", "Buscar"),
    "share": ("Share", "Tweet", "Share on Facebook", "Print", "Home", "Next", "Previous", "Tags"),
    "comments": ("Comments", "3 comments", "Leave a reply", "Reply", "Kommentare", "Commentaires", "Comentarios", "Post a comment"),
    "footer": ("All rights reserved.", "Privacy", "Terms of use", "Impressum", "Contact", "&copy; 2024"),
    "side": ("Related", "Popular", "Most read", "More", "Latest news", "Recommended for you"),
}


class Maker:
    def __init__(self, seed: int, words: list[str]):
        self.r, self.words = random.Random(seed), words

    def some(self, n: int) -> str:
        return " ".join(self.r.choices(self.words, k=n))

    def sentences(self, least: int = 1, most: int = 5) -> str:
        return " ".join(self.some(self.r.randint(3, 14)).capitalize() + self.r.choice((".", ".", ".", "?", "!")) for _ in range(self.r.randint(least, most)))

    def prose(self, least: int, most: int) -> str:
        """Sentences, or now and then a list of words, capitals, marks or repetitions, which also are main text."""
        text, kind = self.sentences(least, most), self.r.random()
        if kind < 0.04:
            return text.replace(" ", " | ")
        if kind < 0.08:
            return " ".join(w + self.r.choice(("%%%", "***", "###", "&amp;&amp;&amp;", "$$$")) for w in text.split())
        if kind < 0.1:
            return text.upper().replace(" ", "!! ")
        if kind < 0.12:
            return " ".join(w for w in text.split()[:6] for _ in range(self.r.randint(2, 9)))
        return text

    def attributes(self, kind: str, sure: float = 1.0) -> str:
        if self.r.random() > sure:
            return ""
        name = self.r.choice(_CLASSES[kind])
        if self.r.random() < 0.2:
            return f' id="{name}"'
        if self.r.random() < 0.3:
            name += " " + self.r.choice(_CLASSES["plain"])
        return f' class="{name}"'

    def links(self, n: int) -> str:
        items = [f'<li><a href="/{self.some(1)}">{self.some(self.r.randint(1, 3))}</a></li>' for _ in range(n)]
        return f"<ul>{''.join(items)}</ul>" if self.r.random() < 0.8 else "".join(f'<a href="/{self.some(1)}">{self.some(1)}</a> | ' for _ in range(n))

    def small(self, kind: str) -> str:
        return self.r.choice(_SMALL[kind]) if self.r.random() < 0.6 else self.sentences(1, 2)

    def nav(self) -> str:
        inner = self.links(self.r.randint(2, 8))
        return f"<nav{self.attributes('nav', 0.3)}>{inner}</nav>" if self.r.random() < 0.7 else f"<div{self.attributes('nav')}>{inner}</div>"

    def header(self) -> str:
        inner = self.r.choice((f"<a href='/'>{self.some(2)}</a>", f"<p>{self.some(4)}</p>", f"<h2>{self.some(2)}</h2>", f"<div>{self.sentences(1, 1)}</div>")) + (self.nav() if self.r.random() < 0.5 else "")
        return f"<header{self.attributes('header', 0.4)}>{inner}</header>" if self.r.random() < 0.6 else f"<div{self.attributes('header')}>{inner}</div>"

    def footer(self) -> str:
        inner = "".join(self.r.choice((f"<p>{self.small('footer')}</p>", self.links(3), f"{self.small('footer')} &middot; {self.some(3)}")) for _ in range(self.r.randint(1, 2)))
        return f"<footer{self.attributes('footer', 0.3)}>{inner}</footer>" if self.r.random() < 0.7 else f"<div{self.attributes('footer')}>{inner}</div>"

    def ad(self) -> str:
        inner = self.r.choice((self.sentences(1, 4), f"<p>{self.sentences(1, 3)}</p>", f"<a href='http://{self.some(1)}.example'>{self.sentences(1, 1)}</a>", f"<h4>{self.some(3)}</h4><p>{self.sentences(1, 2)}</p>"))
        tag = self.r.choice(("div", "div", "div", "aside", "section", "ins", "p"))
        return f"<{tag}{self.attributes('ad')}>{inner}</{tag}>"

    def side(self) -> str:
        inner = f"<h3>{self.small('side')}</h3>" * (self.r.random() < 0.6) + self.r.choice((self.links(self.r.randint(2, 6)), f"<p>{self.sentences(1, 4)}</p>", f"<p>{self.sentences(1, 2)}</p>" * 2, self.sentences(1, 2)))
        return f"<aside{self.attributes('side', 0.5)}>{inner}</aside>" if self.r.random() < 0.6 else f"<div{self.attributes('side')}>{inner}</div>"

    def notice(self) -> str:
        inner = self.r.choice((f"<p>{self.small('notice')}</p>", self.small("notice"), f"<p>{self.sentences(1, 3)}</p>")) + f"<button>{self.small('notice')}</button>" * (self.r.random() < 0.6)
        return f"<{(t := self.r.choice(('div', 'div', 'section', 'dialog')))}{self.attributes('notice')}>{inner}</{t}>"

    def form(self) -> str:
        inner = "".join(self.r.choice((f"<label>{self.small('form')}</label><input name='q'>", f"<p>{self.small('form')}</p>", f"<button>{self.small('form')}</button>", f"<select><option>{self.some(1)}</option><option>{self.some(1)}</option></select>", "<textarea></textarea>")) for _ in range(self.r.randint(1, 4)))
        form = f"<form{self.attributes('form', 0.6)} action='/x'>{inner}</form>"
        return form if self.r.random() < 0.7 else f"<div{self.attributes('form')}>{form}</div>"

    def share(self) -> str:
        inner = self.r.choice((self.links(3), f"<span>{self.small('share')}</span> <a href='/s'>{self.small('share')}</a>", f"<p>{self.small('share')}</p>"))
        return f"<{(t := self.r.choice(('div', 'div', 'ul', 'nav')))}{self.attributes('share')}>{inner}</{t}>"

    def comments(self) -> str:
        def one() -> str:
            text = self.r.choice((f"<p>{self.sentences(1, 5)}</p>", self.sentences(1, 4), f"<b>{self.some(1)}</b><p>{self.sentences(1, 4)}</p>", f"<div>{self.some(2)}</div><div>{self.sentences(1, 3)}</div>"))
            tag = self.r.choice(("div", "li", "article", "section"))
            return f"<{tag}{self.attributes('comment', 0.8)}>{text}</{tag}>"

        head = f"<h3>{self.small('comments')}</h3>" if self.r.random() < 0.7 else ""
        inner = head + "".join(one() for _ in range(self.r.randint(1, 6))) + (self.form() if self.r.random() < 0.4 else "")
        return f"<{(t := self.r.choice(('div', 'section', 'ol', 'div', 'aside')))}{self.attributes('comments')}>{inner}</{t}>"

    def text(self) -> str:
        """Main text in a paragraph, perhaps with inline markup."""
        out = MARK + self.prose(1, 6)
        if self.r.random() < 0.2:
            words = out.split(" ")
            at = self.r.randrange(len(words))
            words[at] = self.r.choice(("<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<code>{}</code>")).format(words[at])
            out = " ".join(words)
        return out

    def article(self) -> str:
        parts = [f"<h1>{MARK}{self.some(self.r.randint(2, 9))}</h1>"] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice((1, 2, 3, 5, 8, 12, 18))):
            parts.append(
                self.r.choices(
                    (
                        f"<p{self.attributes('plain', 0.05)}>{self.text()}</p>", f"<p>{MARK}{self.some(self.r.randint(1, 3)).capitalize()}.</p>", f"<p><b>{self.text()}<br>", f"<h2>{MARK}{self.some(3)}</h2>", f"<blockquote>{self.text()}</blockquote>",
                        "<ul>" + "".join(f"<li>{MARK}{self.sentences(1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>",
                        f"<table><tr><td>{MARK}{self.some(1)}</td><td>{self.some(1)}</td></tr></table>", f"<pre>{MARK}{self.some(5)}</pre>", f"<div>{self.text()}</div>", f"<figure><figcaption>{MARK}{self.some(5)}</figcaption></figure>",
                    ),
                    (60, 8, 8, 6, 3, 4, 2, 1, 4, 1),
                )[0]
            )
        for make in (self.ad, self.share, self.form, self.side, self.notice):
            if self.r.random() < 0.2:
                parts.insert(self.r.randint(1, len(parts)), make())
        if self.r.random() < 0.25:
            parts.insert(len(parts) if self.r.random() < 0.7 else self.r.randint(1, len(parts)), self.comments())
        inner = "".join(parts)
        kind = self.r.random()
        if kind < 0.5:
            return f"<article{self.attributes('main', 0.4)}>{inner}</article>"
        if kind < 0.65:
            return f"<main{self.attributes('main', 0.3)}>{inner}</main>"
        if kind < 0.95:
            return f"<{(t := self.r.choice(('div', 'div', 'section')))}{self.attributes('main')}>{inner}</{t}>"
        return inner

    def page(self) -> str:
        before = [m() for m in (self.header, self.nav, self.notice, self.ad, self.form, self.share, self.side) if self.r.random() < (0.5 if m in (self.nav, self.header) else 0.25)]
        after = [m() for m in (self.side, self.comments, self.ad, self.form, self.share, self.notice) if self.r.random() < 0.25]
        self.r.shuffle(before)
        self.r.shuffle(after)
        main = self.article()
        if self.r.random() < 0.2:
            main = f"<main>{main}</main>" if self.r.random() < 0.5 else f"<div{self.attributes('plain')}>{main}</div>"
        body = "".join(before) + main + "".join(after) + (self.footer() if self.r.random() < 0.85 else "")
        if self.r.random() < 0.3:
            body = f"<div{self.attributes('plain')}>{body}</div>"
        end = "</body></html>" if self.r.random() < 0.9 else ""
        head = f"<title>{self.some(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script>"
        loose = self.r.random()  # tags that may be left out
        if loose < 0.06:
            return f"{head}{body}{end}"
        if loose < 0.12:
            return f"<html><head>{head}{body}{end}"
        if loose < 0.16:
            body = re.sub(r'="([a-z-]+)"', r"=\1", body)  # no quotes where none are needed
        return f"<!DOCTYPE html><html><head>{head}</head><body>{body}{end}"


def pages(n: int, seed: int) -> list[str]:
    out = []
    for i in range(n):
        if i % 50 == 0:  # pages in another language
            r = random.Random(seed * 100_003 + n + i)
            words = ["".join(r.choices(_SYLLABLES, k=k)) for k in r.choices((1, 2, 3, 4), k=400)]
        out.append(Maker(seed * 100_003 + i, words).page())
    return out
