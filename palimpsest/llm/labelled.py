"""Labelled pages for training: layouts made from a seed, each with the text that belongs to its article."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ren tas ver un do si pel gar nu".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: A page of an article without the usual boxes around and beside it.
        self.bare = self.r.random() < 0.35
        self.text: list[str] = []

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi))).capitalize()

    def sentence(self) -> str:
        return self.words(5, 18) + self.r.choice(["."] * 6 + ["!", "?"])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5])))

    def keep(self, text: str) -> str:
        self.text.append(text)
        return text

    def some(self, chance: float, make) -> str:
        return make() if self.r.random() < chance else ""

    # what is not content

    def links(self, n: int, text: str = "li") -> str:
        return "".join(f'<{text}><a href="/{i}">{self.words(1, 3)}</a></{text}>' for i in range(n))

    def menu(self) -> str:
        body = f"<ul>{self.links(self.r.randint(3, 8))}</ul>"
        return self.r.choice([f"<nav>{body}</nav>", f'<div class="menu">{body}</div>', f'<div id="navigation">{body}</div>', f'<nav class="breadcrumb">{self.links(3, "span")}</nav>'])

    def top(self) -> str:
        return self.r.choice([f"<header><h1>{self.words(1, 3)}</h1></header>", f"<header><h1>{self.words(1, 3)}</h1><p>{self.words(3, 8)}</p></header>", f'<div class="masthead"><div class="logo">{self.words(1, 2)}</div>{self.menu()}</div>', f"<header><div>{self.words(1, 3)}</div>{self.menu()}</header>"])

    def bottom(self) -> str:
        return self.r.choice([f"<footer>&copy; {self.words(1, 3)} &middot; {self.sentence()}</footer>", f"<footer><p>{self.prose()}</p><ul>{self.links(4)}</ul></footer>", f'<div class="footer"><p>&copy; {self.prose()}</p></div>', f'<div id="footer">{self.words(2, 6)} <a href="/p">{self.words(1, 2)}</a></div>'])

    def side(self) -> str:
        body = f"<h3>{self.words(1, 3)}</h3><ul>{self.links(self.r.randint(2, 6))}</ul>" + self.some(0.6, lambda: f"<p>{self.prose()}</p>")
        return self.r.choice([f"<aside>{body}</aside>", f'<div class="sidebar">{body}</div>', f'<aside class="related">{body}</aside>', f'<div class="widget">{body}</div>', f'<section class="related"><h2>{self.words(1, 3)}</h2><p>{self.prose()}</p></section>', f"<aside>{self.sentence()}</aside>", f"<aside><p>{self.prose()}</p></aside>"])

    def advert(self) -> str:
        return self.r.choice([f'<div class="ad">{self.sentence()}</div>', f'<div class="advert"><p>{self.prose()}</p></div>', f'<div class="sponsored"><a href="/x">{self.words(2, 6)}</a><p>{self.sentence()}</p></div>', f'<aside class="promo"><p>{self.prose()}</p></aside>', f'<section id="ads"><div>{self.prose()}</div></section>'])

    def notice(self) -> str:
        return self.r.choice([f'<div class="cookie-notice"><p>{self.prose()}</p><button>{self.words(1, 2)}</button></div>', f'<div class="notice">{self.sentence()}</div>', f'<div role="alert">{self.sentence()}</div>', f'<div id="consent-banner"><p>{self.prose()}</p></div>', f'<p class="notice">{self.sentence()}</p>'])

    def form(self) -> str:
        return self.r.choice([f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 1)}</button></form>', f'<div class="newsletter"><p>{self.prose()}</p><form><input><button>{self.words(1, 2)}</button></form></div>', f'<form><p>{self.sentence()}</p><textarea>{self.words(1, 3)}</textarea></form>'])

    def share(self) -> str:
        return self.r.choice([f'<div class="share"><ul>{self.links(3)}</ul></div>', f'<ul class="social">{self.links(4)}</ul>'])

    def comments(self) -> str:
        one = lambda: self.r.choice([f'<div class="comment"><p>{self.prose()}</p></div>', f"<li><b>{self.words(1, 2)}</b><p>{self.prose()}</p></li>", f"<article class=\"comment\"><p>{self.prose()}</p></article>", f"<p>{self.prose()}</p>"])
        body = f"<h2>{self.words(1, 2)}</h2>" + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.r.choice([f'<section class="comments">{body}</section>', f'<div id="comments">{body}</div>', f'<ol class="comment-list">{body}</ol>', f'<div class="reader-comments">{body}</div>'])

    # what is

    def paragraph(self) -> str:
        t, r = self.prose(), self.r
        w = t.split(" ")
        self.keep(t)
        k = r.randrange(len(w))
        form = r.random()
        if form < 0.2:
            w[k] = f"<b>{w[k]}</b>"
        elif form < 0.4:
            w[k] = f'<a href="/w">{w[k]}</a>'
        elif form < 0.5 and k:
            w[k] = f"<br>{w[k]}"
        elif form < 0.6:
            return f"<p><b>{' '.join(w)}<br>"
        return f"<p>{' '.join(w)}" + ("</p>" if r.random() < 0.9 else "")

    def piece(self) -> str:
        r = self.r.random()
        if r < 0.72:
            return self.paragraph()
        if r < 0.8:
            return f"<h2>{self.keep(self.words(1, 6))}</h2>"
        if r < 0.87:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.keep(self.r.choice([self.sentence, lambda: self.words(2, 6)])())}</li>" for _ in range(self.r.randint(2, 4))) + f"</{tag}>"
        if r < 0.93:
            return "<blockquote>" + self.r.choice([self.paragraph, lambda: self.keep(self.sentence())])() + "</blockquote>"
        if r < 0.94:
            return "<dl>" + "".join(f"<dt>{self.keep(self.words(1, 3))}</dt><dd>{self.keep(self.sentence())}</dd>" for _ in range(2)) + "</dl>"
        if r < 0.95:
            return f'<p><a href="/l">{self.keep(self.sentence())}</a></p>'
        if r < 0.955:
            return f"<pre>{self.keep(self.words(3, 9))}</pre>"
        if r < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>"
        return f"<figure><img src=x><figcaption>{self.keep(self.sentence())}</figcaption></figure>"

    def story(self) -> str:
        r = self.r
        title = self.words(2, 10)
        head = r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h1 class=\"title\">{title}</h1>"])
        self.keep(title)
        body = head
        if r.random() < 0.2:
            self.text.pop()
            body = ""
        for _ in range(r.randint(1, 9)):
            body += self.piece()
            if r.random() < 0.22:
                body += r.choice([self.advert, self.share, self.side, self.form, self.notice, lambda: f"<aside>{r.choice([self.sentence(), self.words(2, 6)])}</aside>"])()
        if r.random() < 0.25:
            body = f'<div class="{r.choice(["entry-content", "article-body", "text", "post-content"])}">{body}</div>'
        if r.random() < 0.2:
            body += self.comments()
        if r.random() < (0.7 if self.bare else 0.2):
            return body
        return r.choice([f"<article>{body}</article>"] * 3 + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", f'<div class="post">{body}</div>', f'<div id="content">{body}</div>', f'<section class="article">{body}</section>', f'<div id="main"><div class="story">{body}</div></div>'])

    def wrapped(self, body: str, most: int) -> str:
        """Boxes that say nothing, or little."""
        for _ in range(self.r.randint(0, most)):
            said = self.r.choice(["", "", ' class="wrap"', ' class="container"', ' id="page"', ' class="row"', ' class="inner"', ' class="content"'])
            body = f"<div{said}>{body}</div>"
        return body

    def page(self) -> tuple[str, str]:
        often = (lambda chance: chance / 6) if self.bare else (lambda chance: chance)
        some = lambda chance, make: self.some(often(chance), make)
        before = some(0.4, self.top) + some(0.8, self.menu) + some(0.3, self.notice) + some(0.5, self.advert) + some(0.2, self.form)
        middle = self.wrapped(self.story(), 3)
        after = some(0.3, self.comments) + some(0.4, self.side) + some(0.2, self.form) + some(0.2, self.advert) + some(0.9, self.bottom) + some(0.15, self.notice)
        if self.r.random() < 0.2:
            middle = f'<div class="wrapper">{some(0.5, self.side)}{middle}</div>'
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if self.r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{self.wrapped(before + middle + after, 3)}</body></html>", "\n\n".join(self.text)


def labelled_pages(n: int = 480, seed: int = 7) -> list[tuple[str, str]]:
    return [_Maker(seed * 100_003 + i).page() for i in range(n)]
