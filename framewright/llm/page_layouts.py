"""Labelled pages that the extractor learns from, put together from labelled parts.

Slots in braces are filled with made-up words, so that nothing but markup and the form
of a text tells its label: {w} a word, {t} a few words, {s} a sentence, {p} a paragraph,
{l} a few linked list items.
"""

from __future__ import annotations

import random
import re

MARK = ""  # opens each filled slot of main text, so that blocks show their label

# Where main text stands, what it is made of, and what stands around it.
FRAMES = """
<article>{}</article>
<article class="post">{}</article>
<main>{}</main>
<main><article>{}</article></main>
<div id="page"><article>{}</article></div>
<div class="wrapper"><main id="main" role="main">{}</main></div>
<div class="post-content">{}</div>
<div class="article-body">{}</div>
<div id="content">{}</div>
<div id="story"><div class="text">{}</div></div>
<div class="entry-content" itemprop="articleBody">{}</div>
<section class="entry">{}</section>
<section><article>{}</article></section>
<div class="container"><div class="row"><div class="column">{}</div></div></div>
<div>{}</div>
<table><tr><td>{}</td></tr></table>
<article><header><h1>{t}</h1></header>{}</article>
<article><div class="body">{}</div></article>
""".strip().splitlines()

MAIN = """
<h1>{t}</h1>
<h2>{t}</h2>
<h3>{t}</h3>
<p>{p}</p>
<p>{p}</p>
<p>{p}</p>
<p>{p}</p>
<p>{p}</p>
<p>{s}</p>
<p>{s}</p>
<p>{w}.</p>
<p>{t}</p>
<p>{s}<br>{s}</p>
<p><b>{s}<br><p>{p}</p>
<p>{s} <a href="/x">{t}</a> {s}</p>
<p><strong>{t}</strong> <em>{s}</em></p>
<div>{p}</div>
<div class="section"><p>{p}</p><p>{p}</p></div>
<section><h2>{t}</h2><p>{p}</p></section>
<blockquote>{p}</blockquote>
<blockquote><p>{s}</p></blockquote>
<pre>{s}</pre>
<ul><li>{s}</li><li>{s}</li><li>{t}</li></ul>
<ol><li>{p}</li><li>{p}</li></ol>
<dl><dt>{t}</dt><dd>{s}</dd></dl>
<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{t}</td></tr></table>
<figure><img src="x"><figcaption>{s}</figcaption></figure>
""".strip().splitlines()

BEFORE = """
<header><h1><a href="/">{t}</a></h1><p>{s}</p></header>
<header>{t}</header>
<header class="site-header"><div class="logo">{t}</div>{l}</header>
<div id="header"><p>{s}</p></div>
<div class="topbar">{s}</div>
<nav>{l}</nav>
<nav class="navbar"><a href="/">{w}</a> <a href="/">{w}</a></nav>
<div class="nav">{l}</div>
<div class="menu">{l}</div>
<ul class="menu">{l}</ul>
<div role="navigation">{l}</div>
<div class="breadcrumbs"><a href="/">{w}</a> &gt; <a href="/">{w}</a> &gt; {t}</div>
<form class="search"><label>{t}</label><input><button>{w}</button></form>
<form action="/login"><p>{s}</p><input><button>{t}</button></form>
<p class="skip"><a href="#main">{t}</a></p>
""".strip().splitlines()

ANYWHERE = """
<div class="ad">{s}</div>
<div class="ads"><p>{p}</p></div>
<div class="advert">{s}</div>
<div class="advertisement"><p>{p}</p></div>
<div id="ad-slot-1">{s}</div>
<div class="adbox">{s}</div>
<div class="adunit"><p>{s}</p></div>
<div class="adsbygoogle">{s}</div>
<aside class="ad">{p}</aside>
<div class="sponsored"><p>{p}</p></div>
<div class="sponsor">{s}</div>
<div class="promo"><h3>{t}</h3><p>{s}</p></div>
<div class="banner">{s}</div>
<aside><p>{p}</p></aside>
<aside><h3>{t}</h3>{l}</aside>
<aside class="sidebar"><h2>{t}</h2><p>{p}</p></aside>
<div class="sidebar"><h3>{t}</h3>{l}<p>{s}</p></div>
<div id="sidebar"><p>{p}</p></div>
<div class="widget"><h4>{t}</h4><p>{s}</p></div>
<div class="cookie-notice"><p>{p}</p><button>{w}</button></div>
<div id="cookies" role="dialog">{s} <a href="/">{t}</a></div>
<div class="consent gdpr"><p>{p}</p></div>
<div class="notice"><p>{s}</p></div>
<div class="notice">{p}</div>
<div class="alert" role="alert">{s}</div>
<div class="notification">{s}</div>
<div class="popup"><p>{p}</p></div>
<div class="modal" role="dialog"><h2>{t}</h2><p>{p}</p></div>
<dialog><p>{s}</p></dialog>
<form><label>{t}</label><input><p>{s}</p><button>{w}</button></form>
<form class="newsletter"><p>{p}</p><input></form>
<div class="newsletter"><h3>{t}</h3><p>{s}</p></div>
<div class="subscribe"><p>{p}</p></div>
<div class="share"><a href="/">{w}</a> <a href="/">{w}</a></div>
<div class="social">{l}</div>
<div class="related"><h3>{t}</h3>{l}</div>
<div class="recommended"><p><a href="/">{s}</a></p></div>
<div class="tags"><a href="/">{w}</a> <a href="/">{w}</a></div>
<nav class="pagination"><a href="/">{w}</a> <a href="/">{w}</a></nav>
""".strip().splitlines()

AFTER = """
<footer>&copy; {w} &middot; {s}</footer>
<footer><p>{p}</p>{l}</footer>
<footer>{l}<p>&copy; {t}</p></footer>
<footer>{p}</footer>
<div id="footer"><p>{p}</p></div>
<div class="footer">{l}</div>
<div class="copyright">&copy; {t}</div>
<section class="comments"><h2>{t}</h2><div class="comment"><p>{p}</p></div><p>{s}</p></section>
<section id="comments"><article class="comment"><h4>{w}</h4><p>{p}</p></article></section>
<div class="comments"><ul><li>{p}</li><li>{s}</li></ul></div>
<div id="comments"><h3>{t}</h3><p>{p}</p><p>{p}</p></div>
<ol class="commentlist"><li><p>{p}</p></li><li>{p}</li></ol>
<div class="user-comments"><div>{w}</div><p>{p}</p><blockquote>{s}</blockquote></div>
<div class="discussion"><p>{p}</p><p>{s}</p></div>
<div class="replies"><div class="reply"><p>{p}</p></div></div>
<div class="reviews"><p>{p}</p></div>
<div class="responses"><p>{p}</p></div>
""".strip().splitlines()

HEAD = (
    "<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a='</p>';"
    "</script></head><body>"
)
ALPHABETS = ("abdefghilmnoprstuvw", "aeioulnrstdéèêàç", "aeiourntsñóáé", "aeinrstüöäßchk")
_SLOT = re.compile(r"\{([wtspl])\}")


class _Filler:
    def __init__(self, rng: random.Random):
        self.rng = rng
        letters = rng.choice(ALPHABETS)
        self.words = ["".join(rng.choices(letters, k=rng.randint(1, 11))) for _ in range(200)]

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randint(least, most))).capitalize()

    def sentence(self) -> str:
        return self.phrase(1, self.rng.choice([6, 30])) + self.rng.choice("....!?")

    def slot(self, kind: str, mark: str) -> str:
        if kind == "l":
            items = (f'<li><a href="/">{self.phrase(1, 4)}</a></li>' for _ in range(self.rng.randint(2, 7)))
            return f"<ul>{''.join(items)}</ul>"
        if kind == "w":
            return mark + self.rng.choice(self.words)
        if kind == "t":
            return mark + self.phrase(1, 9)
        count = 1 if kind == "s" else self.rng.choice([1, 2, 4, 12])
        return mark + " ".join(self.sentence() for _ in range(count))

    def fill(self, part: str, mark: str = "") -> str:
        return _SLOT.sub(lambda found: self.slot(found[1], mark), part)


def labelled_page(rng: random.Random) -> str:
    """A page whose blocks of main text hold ``MARK``."""
    filler = _Filler(rng)
    noise = 0.0 if rng.random() < 0.4 else 0.25
    inner = ["<h1>{t}</h1>"] if rng.random() < 0.7 else []
    inner += rng.choices(MAIN, k=rng.choice([1, 3, 6, 12]))
    main = []
    for part in inner:
        main.append(filler.fill(part, MARK))
        if rng.random() < noise:
            main.append(filler.fill(rng.choice(ANYWHERE)))
    if rng.random() < 0.2:  # comments, a footer or a header that the article holds
        main.append(filler.fill(rng.choice(AFTER)))
    frame = rng.choice(FRAMES).replace("{}", "\0")
    body = filler.fill(frame, MARK).replace("\0", "\n".join(main))
    before = rng.sample(BEFORE, rng.randint(0, 4)) + rng.sample(ANYWHERE, rng.randint(0, 3))
    after = rng.sample(AFTER, rng.randint(0, 3)) + rng.sample(ANYWHERE, rng.randint(0, 3))
    rng.shuffle(after)
    parts = [*map(filler.fill, before), body, *map(filler.fill, after)]
    ending = "</body></html>" if rng.random() < 0.9 else ""
    return filler.fill(HEAD.replace("{{}}", "{ }")) + "\n".join(parts) + ending


def labelled_pages(count: int, seed: int) -> list[str]:
    return [labelled_page(random.Random(f"{seed}:{i}")) for i in range(count)]
