"""Labelled pages to train the extraction model: made by rule from a seed, in many layouts.

An element with data-y="1" is content and one with data-y="0" is not; an
element without the attribute has its parent's label.
"""

from __future__ import annotations

import random

PAGES = 420
SEED = 11

_SYLLABLES = "ba ko mi ren tal su vor ne li da ther ing ou st er an".split()
_MAIN = ["<article data-y=1>|</article>", "<main data-y=1>|</main>", '<div data-y=1 class="content">|</div>', '<div data-y=1 id="main-content">|</div>', '<div data-y=1 class="post-body entry">|</div>', '<section data-y=1 class="article-text">|</section>', '<div data-y=1 class="story">|</div>', '<main><article data-y=1 class="post">|</article></main>', '<div id="page"><div class="row"><article data-y=1>|</article></div></div>', "<div data-y=1>|</div>", '<div class="wrapper"><div data-y=1 role="main">|</div></div>']
_NAV = ["<nav>|</nav>", '<div class="menu">|</div>', '<ul class="nav navbar">|</ul>', '<div id="navigation" role="navigation">|</div>', '<div class="breadcrumbs">|</div>', '<nav class="toc">|</nav>']
_TOP = ["<header>|</header>", '<div class="header">|</div>', '<div id="masthead">|</div>', '<header class="site-header" role="banner">|</header>', '<div class="topbar">|</div>']
_FOOT = ["<footer>|</footer>", '<div class="footer">|</div>', '<div id="site-footer" role="contentinfo">|</div>', '<div class="copyright legal">|</div>']
_SIDE = ["<aside>|</aside>", '<div class="sidebar">|</div>', '<div id="secondary" class="widget-area">|</div>', '<div class="related">|</div>', '<div class="recommended links">|</div>', '<section class="widget">|</section>']
_AD = ['<div class="ad">|</div>', '<div class="ads">|</div>', '<div class="advert">|</div>', '<div class="advertisement">|</div>', '<div class="sponsored promo">|</div>', '<aside class="ad-slot">|</aside>', '<div class="banner">|</div>', '<section class="promotion">|</section>', '<div id="adbox">|</div>']
_NOTICE = ['<div class="cookie-notice">|</div>', '<div class="notice">|</div>', '<div class="alert">|</div>', '<div id="cookie-consent" role="dialog">|</div>', '<div class="gdpr banner">|</div>', '<div class="popup modal">|</div>', '<div class="paywall subscribe">|</div>', '<section class="notification">|</section>']
_COMMENTS = ['<section class="comments">|</section>', '<div id="comments">|</div>', '<ol class="comment-list">|</ol>', '<div class="responses discussion">|</div>', '<section id="disqus-thread" class="replies">|</section>']


def _words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join(" ".join(_words(rng, rng.randint(1, 16))).capitalize() + rng.choice([".", ".", ".", ",", " |", "!", "?"]) for _ in range(n))


def _links(rng: random.Random, n: int) -> str:
    items = [f'<a href="/{w}">{w}</a>' for w in _words(rng, n)]
    return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " ".join(items)


def _wrap(rng: random.Random, choices: list[str], inner: str, label: int = 0) -> str:
    outer = rng.choice(choices)
    if "data-y" not in outer:
        at = outer.index(">") if outer.index(">") < outer.index("|") else len(outer)
        outer = f"{outer[:at]} data-y={label}{outer[at:]}"
    return outer.replace("|", inner)


def _off(rng: random.Random) -> str:
    """A piece that is not content, of the kinds that also stand inside articles."""
    kind = rng.randrange(5)
    if kind == 0:
        return _wrap(rng, _AD, _sentences(rng, rng.randint(1, 4)) if rng.random() < 0.5 else f"<p>{_sentences(rng, rng.randint(1, 4))}</p>")
    if kind == 1:
        return _wrap(rng, _SIDE, f"<h3>{_sentences(rng, 1)}</h3>{_links(rng, rng.randint(2, 6))}" if rng.random() < 0.6 else f"<p>{_sentences(rng, rng.randint(1, 5))}</p>")
    if kind == 2:
        return _wrap(rng, _NOTICE, f"<p>{_sentences(rng, rng.randint(1, 4))}</p><button>{_words(rng, 1)[0]}</button>" if rng.random() < 0.6 else _sentences(rng, rng.randint(1, 3)))
    if kind == 3:
        return f'<form data-y=0 class="{rng.choice(["search", "newsletter", "login", ""])}"><label>{_sentences(rng, 1)}</label><input name="q"><p>{_sentences(rng, 1)}</p><select><option>{_words(rng, 1)[0]}<option>{_words(rng, 1)[0]}</select><textarea>{_sentences(rng, 1)}</textarea><button>{_words(rng, 1)[0]}</button></form>'
    return f'<div data-y=0 class="{rng.choice(["share", "social", "tags", "byline-tools", "pagination"])}">{_links(rng, rng.randint(2, 5))}</div>'


def _comments(rng: random.Random) -> str:
    one = [rng.choice(['<div class="comment"><h4>{w}</h4><p>{s}</p></div>', '<li class="comment"><p>{s}</p></li>', "<article class=comment><header>{w}</header><p>{s}</p><p>{s}</p></article>", "<p>{s}</p>"]).format(w=_words(rng, 1)[0], s=_sentences(rng, rng.randint(1, 6))) for _ in range(rng.randint(1, 5))]
    return _wrap(rng, _COMMENTS, f"<h3>{_sentences(rng, 1)}</h3>" * (rng.random() < 0.5) + "".join(one))


def _article(rng: random.Random) -> str:
    out = []
    if rng.random() < 0.8:
        title = f"<h1>{_sentences(rng, 1)}</h1>"
        out.append(f"<header>{title}<p>{_sentences(rng, 1)}</p></header>" if rng.random() < 0.2 else title)
    if rng.random() < 0.12:
        out += [f"<p>{_sentences(rng, 1)}</p>"] * rng.choice([5, 20, 60])
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12, 30])):
        kind = rng.random()
        text = _sentences(rng, rng.choice([1, 1, 2, 4, 8, 8, 40]))
        if rng.random() < 0.1:
            text = " ".join(_words(rng, rng.choice([5, 60, 400])))
        if kind < 0.62:
            out.append(f"<p>{text}</p>")
        elif kind < 0.7:
            out.append(f"<p><b>{text}<br>")
        elif kind < 0.76:
            out.append(f"<h2>{_sentences(rng, 1)}</h2><p>{text}")
        elif kind < 0.82:
            out.append("<ul>" + "".join(f"<li>{_sentences(rng, 1)}" for _ in range(3)) + "</ul>")
        elif kind < 0.86:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.89:
            out.append(f"<table><tr><td>{_words(rng, 1)[0]}<td>{_sentences(rng, 1)}</table>")
        elif kind < 0.92:
            out.append(f"<figure><img src=x><figcaption>{_sentences(rng, 1)}</figcaption></figure>")
        elif kind < 0.95:
            out.append(f"<pre>{text}</pre>")
        elif kind < 0.97:
            out.append(text)
        else:
            out.append(f'<p>{text} <a href="/x">{_words(rng, 1)[0]}</a></p>')
        if rng.random() < 0.07:
            out.append(_off(rng))
    if rng.random() < 0.08:
        out.append(_comments(rng))
    if rng.random() < 0.08:
        out.append(f"<footer data-y=0>{_sentences(rng, 1)}</footer>")
    return "".join(out)


def labelled_pages() -> list[str]:
    """PAGES labelled pages, the same on every call."""
    rng = random.Random(SEED)
    out = []
    for _ in range(PAGES):
        before, after = [], []
        if rng.random() < 0.4:
            before.append(_wrap(rng, _TOP, (f"<h1>{_words(rng, 1)[0]}</h1>" if rng.random() < 0.5 else f"<p>{_sentences(rng, 1)}</p>") + (_wrap(rng, _NAV, _links(rng, rng.randint(3, 7))) if rng.random() < 0.5 else "")))
        if rng.random() < 0.8:
            before.append(_wrap(rng, _NAV, _links(rng, rng.randint(2, 7))))
        for _ in range(rng.choice([0, 1, 1, 2])):
            (before if rng.random() < 0.6 else after).append(_off(rng))
        if rng.random() < 0.35:
            after.append(_comments(rng))
        if rng.random() < 0.3:
            after.append(_wrap(rng, _SIDE, f"<h3>{_sentences(rng, 1)}</h3>" + _links(rng, rng.randint(2, 6))))
        if rng.random() < 0.85:
            after.append(_wrap(rng, _FOOT, f"&copy; {_sentences(rng, rng.randint(1, 3))}" if rng.random() < 0.6 else _links(rng, 3) + f"<p>{_sentences(rng, 1)}</p>"))
        main = _wrap(rng, _MAIN, _article(rng), 1)
        if rng.random() < 0.06:
            main = "".join(f"<p data-y=1>{_sentences(rng, 3)}</p>" for _ in range(rng.randint(2, 6)))
        head = '<head data-y=0><meta charset="utf-8"><title>t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>' if rng.random() < 0.8 else ""
        out.append(f"<!DOCTYPE html><html data-y=0>{head}<body data-y=0>{''.join(before)}{main}{''.join(after)}" + "</body></html>" * (rng.random() < 0.8))
    return out
