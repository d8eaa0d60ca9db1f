"""Labelled web pages for training the page extractor.

Pages are composed from hand-labelled parts (site headers, menus, notices,
adverts, sidebars, forms, articles, reader comments, footers) in many layouts;
every text block carries its label by construction. Texts are invented words.
"""

from __future__ import annotations

import random

SYLLABLES = "ba re ti lo mu sen dor ka vi pel an tor ei su chen la ro mi za un gra fe".split()
WRAPS = [  # where an article stands
    ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article class='post'>", "</article></main>"),
    ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div id='content'>", "</div>"),
    ("<section class='entry'>", "</section>"), ("<div class='article-body'>", "</div>"),
    ("<table><tr><td class='story'>", "</td></tr></table>"), ("<div class='page'><div class='text'>", "</div></div>"),
    ("<div>", "</div>"), ("", ""),
]


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: dict[str, int] = {}
        self.count = 0

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 3))) for _ in range(n))

    def text(self, label: int, lo: int, hi: int, end: str = "") -> str:
        self.count += 1
        t = f"{self.words(self.r.randint(lo, hi)).capitalize()}{self.count}{end}"
        self.labels[t] = label
        return t

    def prose(self, label: int) -> str:
        """A paragraph: a few sentences, now and then very short ones."""
        r = self.r
        self.count += 1
        n = r.choice([1, 1, 2, 3, 5, 8])
        t = " ".join(self.words(r.choice([1, 3, 8, 15, 25])).capitalize() + r.choice([".", ".", ".", ",", "!", "?"]) for _ in range(n))
        t = f"{t} {self.words(1)}{self.count}."
        self.labels[t] = label
        return t

    def put(self, *parts: str) -> None:
        self.html.extend(parts)

    def links(self, n: int, tag: str = "li") -> str:
        """Links, each in an element of its own (inline ones make one block;
        blocks without a label count as none of the article)."""
        return "".join(f"<{tag}><a href='/{i}'>{self.text(0, 1, 3)}</a></{tag}>" for i in range(n))

    # -- parts that are not the article
    def header(self) -> None:
        r = self.r
        top = self.text(0, 1, 4)
        self.put(r.choice([
            f"<header><a href='/'>{top}</a><nav><ul>{self.links(5)}</ul></nav></header>",
            f"<nav><ul>{self.links(6)}</ul></nav>", f"<div class='menu'><ul>{self.links(4)}</ul></div>",
            f"<div id='top' class='site-header'><h2>{top}</h2></div><ul class='nav'>{self.links(4)}</ul>",
            f"<nav class='breadcrumb'>{self.links(3, 'span')}</nav>", f"<div role='navigation'>{self.links(5, 'div')}</div>",
            f"<header><h1>{top}</h1><p>{self.text(0, 3, 9)}</p></header>"]))

    def notice(self) -> None:
        t = self.text(0, 5, 25, ".")
        self.put(self.r.choice([
            f"<div class='cookie-notice'>{t}<button>{self.text(0, 1, 2)}</button></div>", f"<div role='alert'>{t}</div>",
            f"<div class='notice'><p>{t}</p></div>", f"<dialog open><p>{t}</p></dialog>", f"<div id='consent'>{t}</div>",
            f"<div class='banner'>{t}</div>", f"<p hidden>{t}</p>", f"<div class='modal popup'>{t}</div>"]))

    def advert(self) -> None:
        t = self.r.choice([lambda: self.text(0, 4, 18, "."), lambda: self.prose(0)])()
        self.put(self.r.choice([
            f"<div class='ad'>{t}</div>", f"<div class='ad'>{t}</div>", f"<div class='advert'><p>{t}</p></div>",
            f"<aside class='promo'>{t}</aside>", f"<div id='ad-top'><a href='#'>{t}</a></div>", f"<ins class='ads'>{t}</ins>",
            f"<div class='sponsored'><h3>{self.text(0, 1, 4)}</h3><p>{t}</p></div>", f"<div class='advertisement'>{t}</div>"]))

    def sidebar(self) -> None:
        h, t = self.text(0, 1, 3), self.prose(0)
        self.put(self.r.choice([
            f"<aside><h3>{h}</h3><p>{t}</p></aside>", f"<div class='sidebar'><h3>{h}</h3><ul>{self.links(4)}</ul><p>{t}</p></div>",
            f"<div class='widget'><h4>{h}</h4><p>{t}</p></div>", f"<section class='related'><h3>{h}</h3><ul>{self.links(4)}</ul></section>",
            f"<aside><p>{t}</p><ul>{self.links(3)}</ul></aside>"]))

    def form(self) -> None:
        t, u = self.text(0, 1, 6), self.text(0, 1, 3)
        self.put(self.r.choice([
            f"<form><label>{t}</label><input name='q'><button>{u}</button></form>",
            f"<div class='newsletter'><p>{t}</p><form><input><button>{u}</button></form></div>",
            f"<form class='search'><input value='x'><button>{u}</button></form><!-- {t} -->",
            f"<form><p>{t}</p><select><option>{u}</option></select><textarea>{self.text(0, 1, 4)}</textarea></form>",
            f"<div class='login'><form>{t}</form></div>"]))

    def share(self) -> None:
        self.put(self.r.choice([f"<div class='share social'>{self.links(3, 'span')}</div>",
                                f"<ul class='social'>{self.links(4)}</ul>", f"<div class='tags'>{self.links(3, 'div')}</div>"]))

    def comments(self) -> None:
        r = self.r
        one = lambda: self.prose(0)
        h = self.text(0, 1, 3)
        self.put(r.choice([
            f"<section class='comments'><h3>{h}</h3><div class='comment'><p>{one()}</p></div><div class='comment'><p>{one()}</p></div></section>",
            f"<section id='comments'><article><p>{one()}</p></article><article><p>{one()}</p></article></section>",
            f"<ol class='comment-list'><li><p>{one()}</p></li><li><p>{one()}</p></li></ol>",
            f"<div class='comment'><p>{one()}</p></div><div class='comment'><b>{h}</b> </div>",
            f"<div class='reader-comments'><h3>{h}</h3><ul><li>{one()}</li><li>{one()}</li></ul></div>",
            f"<div class='replies responses'><p>{one()}</p><p>{one()}</p></div>"]))

    def footer(self) -> None:
        t = "© " + self.words(3) + f" {self.count}"
        self.count += 1
        self.labels[t] = 0
        u = self.text(0, 3, 14, ".")
        self.put(self.r.choice([
            f"<footer>&copy;{t[1:]}</footer>", f"<footer><p>{u}</p><ul>{self.links(3)}</ul></footer>",
            f"<div class='footer'><p>{u}</p></div>", f"<div id='footer'>{u}</div>", f"<footer>{u}</footer>",
            f"<div class='site-footer'><p>&copy;{t[1:]}</p></div>"]))

    # -- the article
    def article(self) -> None:
        r = self.r
        open_, close = r.choice(WRAPS)
        self.put(open_)
        if r.random() < 0.9:
            t = self.text(1, 2, 12, r.choice(["", "."]))
            self.put(r.choice([f"<h1>{t}</h1>", f"<h1>{t}</h1>", f"<header><h1>{t}</h1></header>" if "article" in open_ else f"<h1>{t}</h1>",
                               f"<h2>{t}</h2>"]))
        for _ in range(r.randint(1, 14)):
            t = self.prose(1)
            x = r.random()
            if x < 0.62:
                self.put(r.choice([f"<p>{t}</p>", f"<p>{t}</p>", f"<p><b>{t}<br>", f"<p>{t}", f"<div>{t}</div>"]))
            elif x < 0.70:
                self.put(f"<h{r.randint(2, 4)}>{self.text(1, 1, 8)}</h2><p>{t}</p>")
            elif x < 0.76:
                self.put(f"<ul><li>{t}</li><li>{self.text(1, 1, 12)}</li></ul>")
            elif x < 0.80:
                self.put(f"<blockquote><p>{t}</p></blockquote>")
            elif x < 0.83:
                self.put(f"<pre>{t}</pre>")
            elif x < 0.86:
                self.put(f"<table><tr><td>{t}</td><td>{self.text(1, 1, 4)}</td></tr></table>")
            elif x < 0.88:
                self.put(f"<figure><img><figcaption>{t}</figcaption></figure>")
            else:
                self.put(f"<p>{t}</p>")
                r.choice([self.advert, self.share, self.form, self.sidebar, self.notice])()
        if r.random() < 0.1:
            self.comments()
        self.put(close)

    def build(self) -> tuple[str, dict[str, int]]:
        r = self.r
        self.put("<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a='<p>';</script></head><body>")
        for part, p in ((self.header, 0.9), (self.notice, 0.3), (self.advert, 0.5), (self.sidebar, 0.25), (self.form, 0.2),
                        (self.article, 1.0), (self.share, 0.2), (self.advert, 0.2), (self.comments, 0.4), (self.sidebar, 0.3),
                        (self.form, 0.2), (self.notice, 0.15), (self.footer, 0.9)):
            if r.random() < p:
                part()
        self.put("</body></html>")
        return "".join(self.html), self.labels


def labelled_pages(n: int = 400) -> list[tuple[str, dict[str, int]]]:
    """``(html, {block text: 1 for article text, else 0})`` of ``n`` pages."""
    return [Page(seed).build() for seed in range(n)]
