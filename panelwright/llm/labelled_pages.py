"""Labelled pages for training: page templates of many shapes, filled with made-up words.

Each page is a list of (html, is_content) parts inside wrappers; a text of the page is content if and only
if it bears the marker character, which is taken away again when the page has been parsed.
"""

from __future__ import annotations

import random

MARK = "\u0001"
_SYLLABLES = "ba de fi go lu ma ne po ri sa te vo an el is or um es".split()


def _words(r: random.Random, lo: int, hi: int) -> list[str]:
    return ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]


def _sentence(r: random.Random, lo: int = 4, hi: int = 18) -> str:
    return " ".join(_words(r, lo, hi)).capitalize() + r.choice("....!?")


def _prose(r: random.Random, most: int = 6) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(1, most)))


def _links(r: random.Random, lo: int = 3, hi: int = 10) -> str:
    items = [f'<a href="/{w}">{w}</a>' for w in _words(r, lo, hi)]
    return r.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()


def _attr(r: random.Random, *names: str) -> str:
    name = r.choice(names)
    return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {r.choice(_SYLLABLES)}"', f' class="site-{name}"'])


def _boilerplate(r: random.Random, kind: str) -> str:
    text = lambda: r.choice([_prose(r, 2), _sentence(r), " ".join(_words(r, 1, 5))])
    p = lambda: r.choice([f"<p>{text()}</p>", text(), f"<div>{text()}</div>"])
    if kind == "menu":
        return r.choice([f"<nav>{_links(r)}</nav>", f"<div{_attr(r, 'nav', 'menu', 'navbar', 'breadcrumbs')}>{_links(r)}</div>", f"<ul{_attr(r, 'menu', 'nav')}>" + "".join(f'<li><a href="#">{w}</a></li>' for w in _words(r, 3, 8)) + "</ul>"])
    if kind == "header":
        inner = r.choice([f"<h1>{' '.join(_words(r, 1, 4))}</h1>", p(), f'<a href="/">{" ".join(_words(r, 1, 3))}</a>']) + r.choice(["", _links(r), f"<p>{_sentence(r)}</p>"])
        return r.choice([f"<header>{inner}</header>", f"<div{_attr(r, 'header', 'masthead', 'topbar')}>{inner}</div>"])
    if kind == "footer":
        inner = r.choice([f"&copy; 2020 {text()}", p() + _links(r), _links(r), p()])
        return r.choice([f"<footer>{inner}</footer>", f"<div{_attr(r, 'footer', 'copyright', 'legal')}>{inner}</div>"])
    if kind == "side":
        inner = r.choice([f"<h2>{' '.join(_words(r, 1, 3))}</h2>", f"<h3>{' '.join(_words(r, 1, 3))}</h3>", ""]) + r.choice([_links(r), p() + p(), p()])
        return r.choice([f"<aside>{inner}</aside>", f"<div{_attr(r, 'sidebar', 'widget', 'rail')}>{inner}</div>", f"<section{_attr(r, 'sidebar', 'widget')}>{inner}</section>"])
    if kind == "advert":
        return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{_attr(r, 'ad', 'ads', 'advert', 'sponsored', 'promo')}>{p()}{r.choice(['', p()])}</{t}>"
    if kind == "notice":
        inner = p() + r.choice(["<button>ok</button>", '<a href="#">ok</a>', ""])
        return f"<div{_attr(r, 'cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'popup')}>{inner}</div>"
    if kind == "form":
        inner = f"<label>{' '.join(_words(r, 1, 3))}</label><input><button>go</button>" + r.choice(["", p()])
        return r.choice([f"<form{r.choice(['', _attr(r, 'search', 'login')])}>{inner}</form>", f"<div{_attr(r, 'newsletter', 'subscribe', 'login')}>{p()}<form>{inner}</form></div>"])
    if kind == "comment":
        one = lambda: r.choice([f"<p>{_prose(r, 4)}</p>", f"<div{_attr(r, 'comment', 'reply')}><b>{r.choice(_SYLLABLES)}</b><p>{_prose(r, 3)}</p></div>", f"<li>{_prose(r, 3)}</li>", f"<article{_attr(r, 'comment')}><p>{_prose(r, 3)}</p></article>"])
        inner = r.choice(["", "<h2>Comments</h2>", f"<h3>{' '.join(_words(r, 1, 3))}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6)))
        return f"<{(t := r.choice(['div', 'section', 'ul', 'ol', 'div']))}{_attr(r, 'comments', 'comment-list', 'discussion', 'responses')}>{inner}</{t}>"
    return f"<div{_attr(r, 'share', 'social', 'related', 'tags', 'recommended')}>{r.choice([_links(r), p() + _links(r)])}</div>"


KINDS = ("menu", "header", "footer", "side", "advert", "notice", "form", "comment", "share")


def _content(r: random.Random) -> str:
    def marked(text: str) -> str:
        return MARK + text

    def para() -> str:
        if r.random() < 0.2:
            return f"<p>{marked(_sentence(r, 1, 4))}</p>"
        if r.random() < 0.15:
            return f"<p><b>{marked(_sentence(r))}<br><p>{marked(_prose(r))}</p>"
        if r.random() < 0.1:
            return f'<p>{marked(_sentence(r))} <a href="/x">{" ".join(_words(r, 1, 3))}</a> {_sentence(r)}</p>'
        return f"<p>{marked(_prose(r, 9))}</p>"

    pieces = []
    if r.random() < 0.8:
        head = f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{marked(' '.join(_words(r, 2, 10)))}</{h}>"
        pieces.append(head if r.random() < 0.85 else f"<header>{head}</header>")
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
        roll = r.random()
        if roll < 0.78:
            pieces.append(para())
        elif roll < 0.84:
            pieces.append("<ul>" + "".join(f"<li>{marked(_sentence(r))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif roll < 0.88:
            pieces.append(f"<h2>{marked(' '.join(_words(r, 1, 5)))}</h2>{para()}")
        elif roll < 0.92:
            pieces.append(f"<blockquote>{marked(_prose(r, 3))}</blockquote>")
        elif roll < 0.95:
            pieces.append("<table>" + "".join("<tr>" + "".join(f"<td>{marked(' '.join(_words(r, 1, 3)))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
        elif roll < 0.97:
            pieces.append(f"<pre>{marked(_prose(r, 2))}</pre>")
        else:
            pieces.append(f"<div>{marked(_prose(r))}</div>")
        if r.random() < 0.06:
            pieces.append(_boilerplate(r, r.choice(["advert", "share", "form", "notice", "side"])))
    inner = "".join(pieces)
    shape = r.random()
    if shape < 0.5:
        inner = f"<article{r.choice(['', '', _attr(r, 'post', 'entry', 'story')])}>{inner}</article>"
    elif shape < 0.65:
        inner = f"<main>{inner}</main>"
    elif shape < 0.9:
        inner = f"<div{_attr(r, 'content', 'post', 'entry-content', 'article-body', 'story')}>{inner}</div>"
    if r.random() < 0.25:
        inner = f"<{(t := r.choice(['main', 'div', 'section']))}{r.choice(['', _attr(r, 'main', 'page', 'wrapper', 'container')])}>{inner}</{t}>"
    return inner


def page(seed: int) -> str:
    r = random.Random(seed)
    before = [_boilerplate(r, k) for k in ("notice", "header", "menu", "advert", "form") if r.random() < 0.5]
    after = [_boilerplate(r, k) for k in ("share", "comment", "side", "advert", "form", "notice", "footer") if r.random() < 0.45]
    r.shuffle(before)
    body = "".join(before) + _content(r) + "".join(after)
    if r.random() < 0.3:
        body = f"<div{r.choice(['', _attr(r, 'wrapper', 'container', 'page')])}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title><style>p{{}}</style></head><body>{body}</body></html>"
