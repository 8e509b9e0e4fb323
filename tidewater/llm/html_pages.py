"""Labelled pages to train HTML extraction on: invented pages whose blocks say whether they belong to the main text.

data-main="1" or "0" labels an element and, unless they say otherwise, what lies in it. Pages vary in how they mark the
main text (article, main, named or bare containers) and what stands around and inside it: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, related links and readers' comments, named or bare, short or long.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro sa te vi wo xa yo zen tri sta kle ment tion ing er an ou al".split()
PAGES, SEED = 400, 11


class _Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n))

    def prose(self, low: int, high: int) -> str:
        out, left, plain = [], self.r.randint(low, high), self.maybe(0.3)
        if plain:
            return self.words(left, left)
        while left > 0:
            n = min(left, self.r.randint(2, 18))
            s = self.words(n, n).capitalize()
            if n > 6 and self.r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            if self.r.random() < 0.15:
                s = s.replace(" ", ' <a href="/x">', 1) + "</a>" if " " in s else s
            elif self.r.random() < 0.1:
                s = f"<b>{s}</b>"
            out.append(s + self.r.choice(".....!?"))
            left -= n
        return " ".join(out)

    def any_of(self, *choices: str) -> str:
        return self.r.choice(choices)

    def maybe(self, chance: float) -> bool:
        return self.r.random() < chance

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 4)}</a></li>' for k in range(self.r.randint(low, high)))

    # ------------------------------------------------------------ what stands around the main text

    def named(self, tags: str, names: str, bare: float = 0.05) -> tuple[str, str]:
        """An element of one of the tags with one of the names; sometimes without a name."""
        tag, name = self.r.choice(tags.split()), self.r.choice(names.split())
        how = "" if self.maybe(bare) else f' {self.any_of("class", "class", "id")}="{name}"'
        return f'<{tag}{how} data-main="0">', f"</{tag}>"

    def menu(self) -> str:
        a, b = self.named("nav nav nav div ul", "nav menu main-menu navbar navigation breadcrumbs top-nav")
        if a.startswith("<ul"):
            return a + self.links(2, 9) + b
        inner = f"<ul>{self.links(2, 9)}</ul>" if self.maybe(0.8) else " | ".join(f'<a href="/{k}">{self.words(1, 2)}</a>' for k in range(self.r.randint(2, 7)))
        return a + inner + b

    def header(self) -> str:
        a, b = self.named("header header div", "header site-header masthead topbar branding logo")
        inner = self.any_of("", f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>') + self.any_of("", f"<p>{self.prose(3, 14)}</p>", self.menu())
        return a + (inner or self.words(1, 5)) + b

    def footer(self) -> str:
        a, b = self.named("footer footer footer div", "footer site-footer page-footer copyright bottom-bar legal")
        return a + self.any_of(f"&copy; {self.words(1, 3)} &middot; {self.prose(2, 25)}", f"<p>{self.prose(2, 30)}</p>", f"<ul>{self.links(2, 6)}</ul>", f"<p>&copy; {self.words(1, 4)}</p><p>{self.words(2, 9)}</p>") + b

    def advert(self) -> str:
        a, b = self.named("div div div aside section p ins", "ad ads advert advertisement ad-slot sponsored promo banner-ad adbox sponsor", 0)
        if a.startswith("<ins"):
            return a.replace("<ins", "<div", 1) + self.prose(2, 40) + "</div>"
        if a.startswith("<p"):
            return a + self.prose(2, 40) + b
        return a + self.any_of(self.prose(1, 60), f"<p>{self.prose(2, 60)}</p>", f'<a href="http://x">{self.words(2, 9)}</a>', f"<h3>{self.words(1, 5)}</h3><p>{self.prose(3, 30)}</p>") + b

    def sidebar(self) -> str:
        a, b = self.named("aside aside aside div", "sidebar side widget-area rail secondary")
        if not a.startswith("<aside"):
            a = a.replace("<div ", '<div class="sidebar" ', 1) if "=" not in a[: a.find("data-main")] else a
        return a + "".join(self.any_of(f"<h3>{self.words(1, 4)}</h3><ul>{self.links(2, 6)}</ul>", f"<p>{self.prose(5, 60)}</p>", f"<div><h4>{self.words(1, 3)}</h4><p>{self.prose(5, 40)}</p></div>", self.prose(2, 30)) for _ in range(self.r.randint(1, 3))) + b

    def notice(self) -> str:
        a, b = self.named("div div section dialog p aside", "cookie cookie-notice notice alert consent gdpr-banner newsletter subscribe popup modal paywall announcement", 0)
        if a.startswith("<p"):
            return a + self.prose(3, 40) + b
        return a + self.any_of(self.prose(3, 40), f"<p>{self.prose(4, 50)}</p>", f"<p>{self.prose(4, 30)}</p><button>{self.words(1, 2)}</button>") + b

    def form(self) -> str:
        a, b = self.named("form form form div", "search login contact-form newsletter-form search-form", 0.3)
        if a.startswith("<div"):
            a, b = '<div class="form" data-main="0"><form>', "</form>" + b
        inner = self.any_of(f'<label>{self.words(1, 3)}</label><input name="q">', f"<p>{self.prose(2, 20)}</p>", f"<select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select>", f"<fieldset><legend>{self.words(1, 3)}</legend><label>{self.words(1, 5)} <input></label></fieldset>", f"{self.prose(2, 12)}<textarea>{self.words(0, 4)}</textarea>")
        return a + inner + self.any_of("", f"<button>{self.words(1, 2)}</button>") + b

    def comments(self) -> str:
        a, b = self.named("section section div div ol", "comments comment-list discussion responses reader-comments replies", 0)
        each = []
        for _ in range(self.r.randint(1, 5)):
            tag = "li" if a.startswith("<ol") else self.any_of("div", "div", "article", "p")
            name = self.any_of("", ' class="comment"', ' class="comment-body"', ' class="reply"')
            text = self.prose(2, 90)
            each.append(f"<{tag}{name}>{text if tag == 'p' or self.maybe(0.4) else f'<p>{text}</p>' + self.any_of('', f'<p>{self.prose(2, 40)}</p>')}</{tag}>")
        return a + self.any_of("", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>") + "".join(each) + b + (self.form() if self.maybe(0.2) else "")

    def related(self) -> str:
        a, b = self.named("div section aside", "related related-posts recommended share social popular tags more-stories", 0)
        return a + self.any_of(f"<h3>{self.words(1, 4)}</h3><ul>{self.links(2, 6)}</ul>", f"<p>{self.prose(3, 20)}</p>", " ".join(f'<a href="/s">{self.words(1, 5)}</a>' for _ in range(4))) + b

    def script(self) -> str:
        return self.any_of('<script>var t="</p>";x(1);</script>', "<style>p{margin:0}</style>", "<!-- <p>x</p> -->", f"<noscript><p>{self.prose(2, 9)}</p></noscript>")

    def around(self) -> str:
        return getattr(self, self.any_of("advert", "advert", "notice", "form", "sidebar", "related", "script", "menu"))()

    def within(self) -> str:
        return getattr(self, self.any_of("advert", "advert", "notice", "form", "related", "sidebar", "sidebar", "comments", "footer", "script"))()

    # ------------------------------------------------------------ the main text

    def block(self) -> str:
        longest = self.any_of(*map(str, (3, 12, 60, 200)))
        text = self.prose(1, int(longest))
        kind = self.r.random()
        if kind < 0.06:
            return f'<p>{self.any_of("", self.words(1, 2))}<a href="/y">{text}</a></p>'
        if kind < 0.12:
            return f"<p>{self.any_of('x', '1', '***', self.words(1, 1))}</p>"
        if kind < 0.6:
            return f"<p>{text}</p>"
        if kind < 0.66:
            return f"<p><b>{text}<br><p>{self.prose(1, 40)}</p>"
        if kind < 0.76:
            return f"<h{(h := self.r.randint(2, 4))}>{self.words(1, 9)}</h{h}>"
        if kind < 0.82:
            return f"<{(t := self.any_of('ul', 'ol'))}>" + "".join(f"<li>{self.prose(1, 25)}</li>" for _ in range(self.r.randint(1, 5))) + f"</{t}>"
        if kind < 0.86:
            return f"<blockquote>{self.any_of(text, f'<p>{text}</p>')}</blockquote>"
        if kind < 0.89:
            return f"<pre>{self.words(2, 20)}</pre>"
        if kind < 0.92:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if kind < 0.95:
            return f'<figure><img src="a.png"><figcaption>{self.prose(2, 15)}</figcaption></figure>'
        return f"<{(t := self.any_of('div', 'section'))}>{text if self.maybe(0.4) else f'<p>{text}</p><p>{self.prose(2, 30)}</p>'}</{t}>"

    def main_text(self) -> str:
        tag, name = self.any_of("article", "article", "article", "main", "div", "div", "section"), self.any_of("content", "article-body", "entry-content", "post", "story", "main-text", "post-body")
        bare = self.maybe(0.7) if tag in ("article", "main") else self.maybe(0.1)
        inner = [f"<h1>{self.words(1, 12)}</h1>"] if self.maybe(0.7) else []
        for _ in range(self.r.choice([0, 1, 2, self.r.randint(3, 12)])):
            inner.append(self.block())
            if self.maybe(0.12):
                inner.append(self.within())
        if not inner or len(inner) == 1 and self.maybe(0.5):
            inner.append(f"<p>{self.prose(1, 80)}</p>")
        if self.maybe(0.25):
            inner.append(self.comments())
        how = "" if bare else f' {self.any_of("class", "id")}="{name}"'
        body = f'<{tag}{how} data-main="1">{"".join(inner)}</{tag}>'
        if self.maybe(0.25):
            outer, names = self.any_of("main", "div", "div"), self.any_of("", ' class="wrapper"', ' id="page"', ' class="container"', ' id="main"')
            more = (self.around() if self.maybe(0.5) else "") + body + (self.around() if self.maybe(0.5) else "") + (self.comments() if self.maybe(0.3) else "")
            body = f'<{outer}{names} data-main="0">{more}</{outer}>'
        return body

    def page(self) -> str:
        before = [f() for f, c in ((self.notice, 0.2), (self.header, 0.35), (self.menu, 0.7), (self.advert, 0.6), (self.form, 0.15), (self.sidebar, 0.15), (self.script, 0.3)) if self.maybe(c)]
        after = [f() for f, c in ((self.comments, 0.35), (self.related, 0.2), (self.sidebar, 0.3), (self.advert, 0.2), (self.form, 0.15), (self.notice, 0.15), (self.footer, 0.85)) if self.maybe(c)]
        head = f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style></head><body>"
        return head + "".join(before) + self.main_text() + "".join(after) + self.any_of("</body></html>", "</body></html>", "")


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    return [_Writer(seed * 100_003 + k).page() for k in range(pages)]
