"""Labelled pages for the field over DOM blocks, made by rule.

``data-main="1"`` and ``"0"`` label an element and what it holds; the label itself
is no feature.  Pages vary in the container of the article (semantic elements,
named or plain divs), in what stands around and inside it, in the length of
paragraphs and in the alphabet of their words.
"""

from __future__ import annotations

import random

# Containers and names that web pages use.
ARTICLES = ("<article>", "<main>", '<main><article>', '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">',
            '<div class="article-body">', '<section class="story">', '<div class="text">', "<div>", "<section>", '<div itemprop="articleBody">')
BEFORE = ("<header>", "<nav>", '<div class="header">', '<div class="menu">', '<ul class="navigation">', '<div id="nav">', '<div class="breadcrumbs">',
          '<div class="cookie-notice">', '<div class="notice">', '<div class="banner">', '<div class="ad">', '<div class="advert">', '<div role="banner">', '<form class="search">')
AFTER = ("<footer>", "<aside>", '<div class="sidebar">', '<div class="footer">', '<div id="comments">', '<section class="comments">', '<div class="related">',
         '<div class="share">', '<div class="newsletter">', '<form class="login">', '<div class="ads">', '<div class="promo">', '<div role="contentinfo">', '<div class="widget">')
INSIDE = ('<div class="ad">', '<div class="comments">', "<aside>", '<div class="share">', '<ul class="tags">', '<form class="subscribe">', "<footer>", "<nav>", '<div class="related">', '<div class="notice">')
SYLLABLES = ("the re an in on er at en nd ti es or te of ed is it al ar st", "der ein sch ung ich ver gen und keit ge be ach ü ä", "le de un que ment é è ou tion eau aux ai", "el la os ción ar ñ do ra es ue ll mente")


def _closing(opening: str) -> str:
    tags = [t.split()[0].strip("<>") for t in opening.split("><")]
    return "".join(f"</{t}>" for t in reversed(tags))


def labelled_pages(n: int = 240, seed: int = 7) -> list[str]:
    """``n`` pages; the same for the same arguments."""
    r = random.Random(seed)

    def words(k: int) -> str:
        parts = r.choice(SYLLABLES).split()
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(k))

    def sentences(k: int) -> str:
        return " ".join((words(r.randint(1, 16)).capitalize() + r.choice(("."," .", "!", "?", ".", "."))) for _ in range(k))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(r.randint(1, 3))}</a></li>' for i in range(k)) + "</ul>"

    def clutter(opening: str) -> str:
        kind = r.random()
        if "comment" in opening:
            body = "".join(f'<div class="comment"><p>{words(1)}: {sentences(r.randint(1, 4))}</p></div>' for _ in range(r.randint(1, 4)))
        elif "form" in opening:
            body = f"<label>{words(2)}</label><input name=q><button>{words(1)}</button>"
        elif kind < 0.4:
            body = links(r.randint(2, 8))
        elif kind < 0.7:
            body = sentences(r.randint(1, 3))
        elif kind < 0.85:
            body = f"<h3>{words(2)}</h3><p>{sentences(r.randint(1, 2))}</p>"
        else:
            body = f"&copy; {words(2)} &middot; {words(r.randint(1, 8))}."
        return opening.replace(">", ' data-main="0">', 1) + body + _closing(opening)

    def block() -> str:
        kind = r.random()
        if kind < 0.72:
            return f"<p>{sentences(r.choice((1, 1, 2, 3, 5, 9)))}</p>"
        if kind < 0.8:
            return f"<h2>{words(r.randint(1, 7)).capitalize()}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{sentences(1)}</li>" for _ in range(r.randint(2, 4))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{sentences(2)}</blockquote>"
        if kind < 0.96:
            return f"<p><b>{sentences(1)}<br><p>{sentences(2)}</p>"
        return f"<table><tr><td>{words(2)}</td><td>{words(1)}</td></tr></table><pre>{words(6)}</pre>"

    pages = []
    for _ in range(n):
        opening = r.choice(ARTICLES)
        body = [f"<h1>{words(r.randint(1, 9)).capitalize()}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((0, 1, 2, 4, 7, 12))):
            body.append(block())
            if r.random() < 0.08:
                body.append(clutter(r.choice(INSIDE)))
        if not body:
            body.append(block())
        article = opening.replace(">", ' data-main="1">', 1) + "".join(body) + _closing(opening)
        before = "".join(clutter(x) for x in r.sample(BEFORE, r.randint(0, 4)))
        after = "".join(clutter(x) for x in r.sample(AFTER, r.randint(0, 4)))
        outer = r.choice(("<div class=\"wrapper\">", "<div id=\"page\">", "", ""))
        pages.append(f"<html><head><title>{words(3)}</title></head><body>{outer}{before}{article}{after}{'</div>' if outer else ''}</body></html>")
    return pages
