"""Labelled pages to train content extraction on: page layouts of many kinds, filled with seeded invented words.

A page is a list of (html, label) pieces in document order; text inside a piece of label 1 is main content.
"""

from __future__ import annotations

import random

_SYLLABLES = "la re ti on en mo sa du ver kel pri ast or in che ma no ul ber gan sto fi que ra".split()


class _Words:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def word(self) -> str:
        return "".join(self.random.choice(_SYLLABLES) for _ in range(self.random.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(low, high))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 18) + self.random.choice([".", ".", "!", "?"]) for _ in range(self.random.randint(low, high)))

    def paragraph(self) -> str:
        kind = self.random.random()
        if kind < 0.12:
            return self.words(1, 3) + self.random.choice([".", ""])
        if kind < 0.18:
            mark = self.random.choice([" | ", "*** ", "### ", ", ", " &amp;&amp; "])
            return mark.join(self.word() for _ in range(self.random.randint(2, 40)))
        if kind < 0.24:
            return self.sentences(1, 3) + f' <a href="/{self.word()}">{self.words(1, 3)}</a> ' + self.sentences(1, 2)
        return self.sentences(1, 7)

    def links(self, low: int, high: int, wrap: str = "ul") -> str:
        found = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.random.randint(low, high))]
        if wrap == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>"
        return " | ".join(found)


def _body(w: _Words) -> str:
    """Headings, paragraphs, lists, quotes, tables and pictures of an article."""
    out = []
    for _ in range(w.random.randint(2, 9)):
        kind = w.random.random()
        if kind < 0.62:
            out.append(f"<p>{w.paragraph()}</p>")
        elif kind < 0.72:
            out.append(f"<h2>{w.words(2, 6)}</h2>")
        elif kind < 0.8:
            out.append("<ul>" + "".join(f"<li>{w.sentences(1, 2)}</li>" for _ in range(w.random.randint(2, 5))) + "</ul>")
        elif kind < 0.86:
            out.append(f"<blockquote><p>{w.sentences(1, 3)}</p></blockquote>")
        elif kind < 0.9:
            cells = "".join(f"<tr><td>{w.words(1, 3)}</td><td>{w.random.randint(1, 999)}</td></tr>" for _ in range(3))
            out.append(f"<table>{cells}</table>")
        elif kind < 0.94:
            out.append(f"<figure><img src=x.png><figcaption>{w.sentences(1, 1)}</figcaption></figure>")
        elif kind < 0.97:
            out.append(f"<pre>{w.words(3, 9)}</pre>")
        else:
            out.append(f"<p><b>{w.sentences(1, 1)}<br><p>{w.paragraph()}</p>")
    return "".join(out)


def _noise(w: _Words, place: str) -> str:
    """Something that is no content, as it stands before, inside or after the article."""
    before = [
        f"<nav>{w.links(3, 9)}</nav>",
        f'<div class="menu">{w.links(3, 9)}</div>',
        f'<div id="navbar">{w.links(3, 8, "bar")}</div>',
        f'<ul class="nav-list"><li><a href="/">{w.words(1, 1)}</a></li><li><a href="/b">{w.words(1, 2)}</a></li></ul>',
        f"<header><h1>{w.words(1, 3)}</h1><p>{w.sentences(1, 1)}</p></header>",
        f'<div class="site-header"><p>{w.words(2, 6)}</p></div>',
        f'<div id="header"><h2>{w.words(1, 4)}</h2></div>',
        f'<div class="breadcrumb">{w.links(2, 4, "bar")}</div>',
        f'<div class="cookie-notice"><p>{w.sentences(1, 3)}</p><button>{w.words(1, 2)}</button></div>',
        f'<div id="consent-banner">{w.sentences(1, 3)}</div>',
        f'<div role="alert" class="notice">{w.sentences(1, 2)}</div>',
        f'<form action="/s"><label>{w.words(1, 2)}</label><input name=q><button>{w.words(1, 1)}</button></form>',
        f'<div class="ad">{w.sentences(1, 2)}</div>',
        f'<div class="topbar"><p>{w.sentences(1, 2)}</p></div>',
        f'<ul id="main-menu">{w.links(2, 6)[4:-5]}</ul>',
        f'<div class="advertisement"><p>{w.paragraph()}</p></div>',
        f'<div role="navigation">{w.links(3, 6)}</div>',
        f'<div role="banner"><p>{w.words(1, 5)}</p></div>',
        f'<div class="search-box"><form><input><select><option>{w.words(1, 1)}</option></select></form></div>',
    ]
    comments = "".join(
        f'<div class="comment"><p>{w.paragraph()}</p></div>' for _ in range(w.random.randint(1, 4))
    )
    inside = [
        f'<section class="comments"><h3>{w.words(1, 2)}</h3>{comments}</section>',
        f'<div id="reader-comments">{comments}</div>',
        f'<ul class="user-comments"><li>{w.paragraph()}</li><li><p>{w.paragraph()}</p></li></ul>',
        f"<aside><p>{w.paragraph()}</p><p>{w.paragraph()}</p></aside>",
        f'<div class="notice">{w.sentences(1, 3)}</div>',
        f'<div class="cookie-banner"><p>{w.sentences(1, 2)}</p><button>{w.words(1, 1)}</button></div>',
        f"<form><p>{w.sentences(1, 1)}</p><label>{w.words(1, 2)}</label><input></form>",
        f'<nav class="toc">{w.links(2, 6)}</nav>',
        f"<footer>{w.sentences(1, 2)}</footer>",
        f'<div class="sidebar"><p>{w.paragraph()}</p>{w.links(2, 4)}</div>',
        f'<div class="ad">{w.sentences(1, 2)}</div>',
        f'<div class="advert"><p>{w.sentences(1, 3)}</p></div>',
        f'<aside class="related"><h3>{w.words(1, 3)}</h3>{w.links(2, 5)}</aside>',
        f'<div class="share-buttons">{w.links(2, 4, "bar")}</div>',
        f'<div class="sponsored">{w.sentences(1, 3)}</div>',
        f'<div class="newsletter-signup"><p>{w.sentences(1, 2)}</p><form><input></form></div>',
        f"<script>var {w.word()} = \"<p>{w.words(2, 5)}</p>\";</script>",
        f"<style>.{w.word()}{{margin:0}}</style>",
        f"<!-- {w.words(2, 5)} -->",
        f'<div class="promo">{w.sentences(1, 1)}</div>',
    ]
    after = [
        f"<footer>&copy; {w.words(1, 3)} &middot; {w.sentences(1, 2)}</footer>",
        f'<div class="footer"><p>{w.sentences(1, 3)}</p>{w.links(2, 6)}</div>',
        f'<div id="footer">{w.links(2, 6, "bar")}<p>{w.words(2, 6)}</p></div>',
        f"<aside><h3>{w.words(1, 3)}</h3><p>{w.paragraph()}</p>{w.links(2, 6)}</aside>",
        f'<div class="sidebar"><h3>{w.words(1, 3)}</h3><p>{w.paragraph()}</p></div>',
        f'<div id="sidebar">{w.links(3, 8)}</div>',
        f'<div class="widget"><p>{w.sentences(1, 2)}</p></div>',
        f'<section class="comments"><h3>{w.words(1, 2)}</h3>{comments}</section>',
        f'<div id="comments">{comments}<form><textarea></textarea></form></div>',
        f'<ol class="comment-list"><li><p>{w.paragraph()}</p></li><li>{w.sentences(1, 3)}</li></ol>',
        f'<div class="related-posts"><h4>{w.words(1, 3)}</h4>{w.links(3, 6)}</div>',
        f'<div class="copyright">{w.sentences(1, 2)}</div>',
        f'<div class="ads"><p>{w.sentences(1, 2)}</p></div>',
        f'<div class="pagination">{w.links(2, 5, "bar")}</div>',
    ]
    return w.random.choice({"before": before, "inside": inside, "after": after}[place])


# How an article is wrapped: what opens and closes it.
_WRAPS = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="article-body">', "</div>"),
    ('<div class="post"><div class="post-content">', "</div></div>"), ('<div id="main"><div class="entry">', "</div></div>"),
    ('<section class="story">', "</section>"), ('<div role="main">', "</div>"),
    ('<div class="wrapper"><div class="text">', "</div></div>"), ('<div><div>', "</div></div>"),
    ('<table><tr><td class="body">', "</td></tr></table>"),
)


def labelled_page(number: int) -> list[tuple[str, int]]:
    """The pieces of page ``number``."""
    w = _Words(number)
    begin, end = _WRAPS[number % len(_WRAPS)]
    title = w.words(2, 9)
    pieces = [(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style></head><body>", 0)]
    pieces += [(_noise(w, "before"), 0) for _ in range(w.random.randint(0, 4))]
    pieces.append((begin, 1))
    heading = w.random.random()
    if heading < 0.5:
        pieces.append((f"<h1>{title}</h1>", 1))
    elif heading < 0.6:
        pieces.append((f"<header><h1>{title}</h1></header>", 1))
    for _ in range(w.random.randint(1, 3)):
        pieces.append((_body(w), 1))
        if w.random.random() < 0.45:
            pieces.append((_noise(w, "inside"), 0))
    pieces.append((end, 1))
    pieces += [(_noise(w, "after"), 0) for _ in range(w.random.randint(0, 4))]
    if w.random.random() < 0.9:
        pieces.append(("</body></html>", 0))
    return pieces
