"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks; each is the article's (1) or not (0). Features are the block's tag, its
ancestors' tags and name words (class, id, role), the share of its text in links, its length and its ends; the
chain's weights join neighbours. Weights are fitted on labelled pages by gradient steps on the conditional
likelihood, and pages are decoded by Viterbi.

The labelled pages are made by ``labelled_pages``: layouts of many kinds (marked up, by names alone, by tables, bare),
whose parts are known to be the article or menus, headers, footers, sidebars, notices, adverts, forms or reader
comments. Other labelled pages can be given to ``fit``. Fitting takes ``TRAIN_PAGES`` pages on the driver, a fixed
number, in a few seconds.

Nulls, empties and ties: a null or empty page has an empty text, as has a page without an article's block. Of
decodings of equal weight the one with fewer article blocks wins. Repeated rows are extracted row by row. An empty
table gives no rows. A page of any length is parsed and decoded whole, in memory that grows with that page. Columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from paceline.llm.dom import Leaf, leaves

TRAIN_PAGES = 400
#: Words of class and id names that speak for or against an article.
GOOD_NAMES = frozenset("article articlebody body content entry hentry main post prose story text".split())
BAD_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie "
    "cookies copyright disqus footer form gdpr header links login masthead menu meta modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted related reply replies respond responses search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget alert reader".split()
)
BAD_PATH = frozenset("nav header footer aside form menu button select dialog fieldset search".split())
GOOD_PATH = frozenset("article main".split())
HOLDERS = frozenset("li td th blockquote section figure figcaption pre dd dt".split())


def signal(tag: str, names: frozenset[str]) -> str:
    """What an element says of its text: bad, good or nothing."""
    if tag in BAD_PATH or names & BAD_NAMES:
        return "bad"
    return "good" if tag in GOOD_PATH or names & GOOD_NAMES else ""


def standing(block: Leaf) -> str:
    """The signals of the block's ancestors from the outermost on, repeats as one: plain, good, bad, good>bad, ..."""
    found: list[str] = []
    for tag, names in zip(block.path, block.names):
        x = signal(tag, names) if tag not in ("html", "body") else ""
        if x and x != (found[-1] if found else ""):
            found.append(x)
    return ">".join(found[-3:]) or "plain"


def features(block: Leaf, index: int, total: int, stands: str, page_stands: str) -> list[str]:
    path, n = set(block.path), len(block.text)
    share = block.link_chars / n
    links = 0 if share < 0.1 else 1 if share < 0.5 else 2 if share < 0.9 else 3
    size = min(5, n.bit_length() // 2)
    out = ["bias", f"links={links}", f"size={size}", f"tag={block.tag}", f"stands={stands}"]
    out += [f"{stands}:{block.tag}", f"{page_stands}:{stands}", f"{stands}:links={links}", f"{stands}:size={size}"]
    out.append("stop" if block.text[-1] in ".!?…。！？" else "nostop")
    where = "@article" if path & GOOD_PATH else ""
    out += [f"in={t}{where}" for t in path & BAD_PATH] + [f"in={t}" for t in path & GOOD_PATH]
    out += [f"in={t}" for t in path & HOLDERS]
    out += [f"in={t}" for t in block.embedded]
    for tag, names in zip(block.path, block.names):
        if tag not in ("html", "body"):
            out += [f"name={w}" for w in names & (GOOD_NAMES | BAD_NAMES)]
    if block.controls:
        out.append("control")
    low = block.text.lower()
    if "©" in low or "copyright" in low or "all rights reserved" in low:
        out += ["copyright", f"copyright:{min(size, 3)}"]
    if index == 0:
        out.append("first")
    if index == total - 1:
        out.append("last")
    return list(dict.fromkeys(out))


class Field:
    """Weights of features, transitions and ends for labels 0 and 1."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, ends: np.ndarray):
        self.names, self.weights, self.moves, self.ends = names, weights, moves, ends

    def emissions(self, page: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(page), 2))
        for i, found in enumerate(page):
            rows = [self.names[x] for x in found if x in self.names]
            out[i] = self.weights[rows].sum(axis=0)
        return out

    def decode(self, page: list[list[str]]) -> list[int]:
        """The labels of greatest weight (Viterbi)."""
        if not page:
            return []
        e = self.emissions(page).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = e[0][0] + self.ends[0, 0], e[0][1] + self.ends[0, 1]
        back = []
        for x, y in e[1:]:
            to0, to1 = (a + m00, b + m10), (a + m01, b + m11)
            from0, from1 = int(to0[1] > to0[0]), int(to1[1] > to1[0])
            back.append((from0, from1))
            a, b = max(to0) + x, max(to1) + y
        label = int(b + self.ends[1, 1] > a + self.ends[1, 0])
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """A field fitted to pages of (features, label) blocks, by Adam on the conditional likelihood."""
    pages = [p for p in pages if p[0]]
    names = {x: i for i, x in enumerate(sorted({x for p, _ in pages for f in p for x in f}))}
    longest, n = max(len(p) for p, _ in pages), len(pages)
    present = np.zeros((n, longest), bool)
    label = np.zeros((n, longest), np.int64)
    table = np.zeros((n, longest, len(names)), np.float32)
    for i, (page, labels) in enumerate(pages):
        present[i, : len(page)], label[i, : len(page)] = True, labels
        for j, found in enumerate(page):
            table[i, j, [names[x] for x in found]] = 1
    size = present.sum(axis=1)
    last = size - 1
    rows = np.arange(n)
    flat = table.reshape(-1, len(names))
    pair = present[:, 1:]
    true_e = np.eye(2)[label] * present[..., None]
    true_m = np.zeros((2, 2))
    np.add.at(true_m, (label[:, :-1][pair], label[:, 1:][pair]), 1)
    true_ends = np.stack([true_e[:, 0].sum(axis=0), true_e[rows, last].sum(axis=0)])
    params = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, m, ends = params
        e = (flat @ w.astype(np.float32)).reshape(n, longest, 2).astype(np.float64)
        forward = np.zeros((n, longest, 2))
        backward = np.zeros((n, longest, 2))
        forward[:, 0] = e[:, 0] + ends[0]
        for t in range(1, longest):
            forward[:, t] = e[:, t] + _log_sum(forward[:, t - 1][:, :, None] + m, 1)
        backward[rows, last] = ends[1]
        for t in range(longest - 2, -1, -1):
            step_back = _log_sum(m + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t < last)[:, None], step_back, backward[:, t])
        whole = _log_sum(forward[rows, last] + ends[1], 1)
        prob = np.exp(np.minimum(forward + backward - whole[:, None, None], 0)) * present[..., None]
        joint = forward[:, :-1, :, None] + m + (e + backward)[:, 1:, None, :] - whole[:, None, None, None]
        joint = np.exp(np.minimum(joint, 0)) * pair[..., None, None]
        grads = [
            (flat.T @ (prob - true_e).reshape(-1, 2).astype(np.float32)).astype(np.float64) / n + decay * w,
            (joint.sum(axis=(0, 1)) - true_m) / n + decay * m,
            (np.stack([prob[:, 0].sum(axis=0), prob[rows, last].sum(axis=0)]) - true_ends) / n + decay * ends,
        ]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field(names, *params)


def page_features(blocks: list[Leaf]) -> list[list[str]]:
    stands = [standing(b) for b in blocks]
    page = "marked" if any("good" in x for x in stands) else "unmarked"
    return [features(b, i, len(blocks), x, page) for i, (b, x) in enumerate(zip(blocks, stands))]


def extract(page: str | None, model: Field) -> str:
    blocks = leaves(page)
    labels = model.decode(page_features(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, labels) if keep)


# Labelled pages

#: Syllables of invented words.
_SYLLABLES = ("an re th on er ing ed ti sh ou le mo ka bri ve so lu".split(), "zu ber ge lich ung ä ö ein sch tz".split(), "가 나 다라 마바 사 하".split())


def _words(r: random.Random, n: int) -> list[str]:
    parts = r.choice(_SYLLABLES) if r.random() < 0.3 else _SYLLABLES[0]
    return ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n)]


def _phrase(r: random.Random, least: int, most: int) -> str:
    line = " ".join(_words(r, r.randint(least, most)))
    return line[:1].upper() + line[1:]


def _prose(r: random.Random, least: int, most: int) -> str:
    """Sentences, some of them without an end, in capitals or with marks in them."""
    out = []
    left = r.randint(least, most)
    while left > 0:
        n = min(left, r.randint(2, 25))
        out.append(_phrase(r, n, n) + r.choice([".", ".", ".", "!", "?", "…", ": ", ", ok."]))
        left -= n
    text = " ".join(out)
    kind = r.random()
    if kind < 0.15:
        text = text.rstrip(".!?… ")
    elif kind < 0.2:
        text = text.upper()
    elif kind < 0.25:
        text = text.replace(" ", r.choice([" * ", " | ", " # ", "-"]))
    return text


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;")


class _Page:
    """A page under construction with the label of each block's text."""

    def __init__(self, r: random.Random):
        self.r, self.html, self.labels = r, [], []

    def raw(self, s: str) -> None:
        self.html.append(s)

    def block(self, tag: str, text: str, label: int, inner: str | None = None) -> None:
        """tag may carry attributes; an end tag that HTML lets out is let out at times."""
        name = tag.split()[0]
        end = "" if name in ("p", "li", "td", "dd", "dt") and self.r.random() < 0.06 else f"</{name}>"
        self.html.append(f"<{tag}>{_escape(text) if inner is None else inner}{end}")
        self.labels.append(label)

    def link(self, tag: str, text: str, label: int) -> None:
        self.block(tag, text, label, inner=f'<a href="/{self.r.randint(1, 99)}">{_escape(text)}</a>')

    def links(self, n: int, most: int = 3) -> None:
        self.raw(self.r.choice(["<ul>", "<ol>", '<ul class="list">']))
        for _ in range(n):
            self.link("li", _phrase(self.r, 1, most), 0)
        self.raw("</ul>" if self.html[-1].startswith("<li") and "<ol>" not in self.html[-n - 1] else "</ol>")

    def inside(self, opening: str, *parts) -> None:
        self.raw(f"<{opening}>")
        for part in parts:
            part()
        self.raw(f"</{opening.split()[0]}>")


def _menu(p: _Page) -> None:
    r = p.r
    holder = r.choice(["nav", "nav", 'div class="menu"', 'div id="navigation"', 'div class="navbar navbar-top"', "header", "div", 'div id="topbar"', 'nav class="main-nav"', "menu"])
    p.inside(holder, lambda: p.links(r.randint(2, 9)))


def _top(p: _Page) -> None:
    r = p.r
    holder = r.choice(["header", "header", 'div id="header"', 'div class="masthead"', 'header class="site-header"'])

    def parts() -> None:
        p.link(r.choice(["h1", "h2", "p", "div"]), _phrase(r, 1, 4), 0) if r.random() < 0.5 else p.block(r.choice(["h1", "h2", "div"]), _phrase(r, 1, 4), 0)
        if r.random() < 0.6:
            p.block("p", _prose(r, 2, 14), 0)
        if r.random() < 0.4:
            p.inside("nav", lambda: p.links(r.randint(2, 6)))

    p.inside(holder, parts)


def _crumbs(p: _Page) -> None:
    p.inside(p.r.choice(['div class="breadcrumb"', 'nav aria-label="breadcrumb"', 'div id="breadcrumbs"']), lambda: p.links(p.r.randint(1, 4)))


def _advert(p: _Page) -> None:
    r = p.r
    p.block(r.choice(['div class="ad"', 'div class="advert"', 'div id="banner"', 'div class="sponsored"', 'section class="promo box"', 'div class="ads ads-top"', 'p class="advertisement"']), _prose(r, 2, 50), 0)


def _notice(p: _Page) -> None:
    r = p.r
    holder = r.choice(['div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'div role="alert"', 'dialog', 'div id="gdpr-banner"', 'div class="popup modal"'])

    def parts() -> None:
        p.block("p", _prose(r, 3, 40), 0)
        if r.random() < 0.5:
            p.block("button", _phrase(r, 1, 2), 0)

    p.block(holder, _prose(r, 3, 40), 0) if r.random() < 0.5 else p.inside(holder, parts)


def _form(p: _Page) -> None:
    r = p.r

    def parts() -> None:
        p.block(r.choice(["p", "div", "label", "h3"]) if r.random() < 0.9 else "legend", _prose(r, 1, 12), 0)
        p.raw('<input name="q">')
        p.block("button", _phrase(r, 1, 2), 0)

    p.inside(r.choice(['form action="/s"', 'form class="search"', 'div class="newsletter"', 'form id="subscribe"']), parts)


def _aside(p: _Page) -> None:
    r = p.r
    holder = r.choice(["aside", 'div class="sidebar"', 'aside class="widget"', 'div id="sidebar-right"', 'div class="widget widget-text"'])

    def parts() -> None:
        for _ in range(r.randint(1, 3)):
            p.block(r.choice(["h3", "h2", "h4"]), _phrase(r, 1, 4), 0)
            if r.random() < 0.5:
                p.links(r.randint(1, 5), 8)
            else:
                p.block("p", _prose(r, 4, 60), 0)

    p.inside(holder, parts)


def _related(p: _Page) -> None:
    r = p.r

    def parts() -> None:
        if r.random() < 0.6:
            p.block(r.choice(["h2", "h3", "h4"]), _phrase(r, 1, 4), 0)
        p.links(r.randint(2, 6), 10)

    p.inside(r.choice(['div class="related"', 'section class="related-posts"', 'aside', 'div id="related-links"', 'div class="promoted"']), parts)


def _sharing(p: _Page) -> None:
    r = p.r
    p.inside(r.choice(['div class="share"', 'div class="social-links"', 'ul class="sharing"', 'div class="tags"']), lambda: [p.link("li", _phrase(r, 1, 2), 0) for _ in range(r.randint(1, 4))])


def _comments(p: _Page) -> None:
    r = p.r
    holder = r.choice(['div class="comments"', 'section id="comments"', 'section class="reader-comments"', 'div id="disqus-thread"', 'div class="responses"', 'ol class="commentlist"'])
    each = r.choice(['div class="comment"', 'article class="comment"', 'li class="comment"', 'div class="comment-body"', "div", "li"])

    def one() -> None:
        if r.random() < 0.4:
            p.block(r.choice(["h4", 'span class="author"', "div", "p"]) if r.random() < 0.9 else "cite", _phrase(r, 1, 3), 0) if r.random() < 0.8 else p.link("p", _phrase(r, 1, 2), 0)
        for _ in range(r.randint(1, 2)):
            p.block("p", _prose(r, 2, 90), 0)
        if r.random() < 0.3:
            p.link("p", _phrase(r, 1, 2), 0)

    def parts() -> None:
        if r.random() < 0.7:
            p.block(r.choice(["h2", "h3", "h4"]), _phrase(r, 1, 3), 0)
        for _ in range(r.randint(1, 5)):
            p.inside(each, one)
        if r.random() < 0.3:
            _form(p)

    p.inside(holder, parts)


def _more(p: _Page) -> None:
    p.link(p.r.choice(["p", "div"]), _phrase(p.r, 1, 8), 0)


def _code(p: _Page) -> None:
    p.raw(p.r.choice(["<script>if (a<b) document.write('<p>x</p>')</script>", "<style>.x{color:red}</style>", "<!-- <div>old</div> -->", '<script type="application/json">{"a": "<p>"}</script>', "<noscript></noscript>"]))


def _bottom(p: _Page) -> None:
    r = p.r
    sign = lambda: r.choice(["© ", "Copyright 20", "© 2019 ", ""]) + _phrase(r, 1, 12) + r.choice(["", ".", ". All rights reserved."])
    kind = r.random()
    if kind < 0.3:
        p.block(r.choice(["footer", "footer", 'div class="footer"', 'div id="copyright"']), sign(), 0)
    elif kind < 0.5:
        p.block(r.choice(["p", "div"]) if r.random() < 0.9 else "center", r.choice(["© ", "Copyright "]) + _phrase(r, 1, 12), 0)
    else:

        def parts() -> None:
            if r.random() < 0.6:
                p.links(r.randint(1, 6))
            if r.random() < 0.5:
                p.block("address", _phrase(r, 2, 9), 0)
            p.block("p", sign() if r.random() < 0.7 else _prose(r, 3, 40), 0)

        p.inside(r.choice(["footer", 'footer class="site-footer"', 'div id="footer"']), parts)


def _paragraph(p: _Page) -> None:
    r = p.r
    text = _prose(r, 1, 5) if r.random() < 0.25 else _prose(r, 4, 130)
    kind = r.random()
    if kind < 0.15:
        p.block("p", text, 1, inner=f'{_escape(text)} <a href="/x">{_phrase(r, 1, 5)}</a> <em>{_phrase(r, 1, 3)}</em>.')
    elif kind < 0.2:
        p.block("p", text, 1, inner=f"<b>{_escape(text)}<br>")
    elif kind < 0.25:
        p.block("div", text, 1)
    else:
        p.block("p", text, 1)


def _part(p: _Page, deep: int = 0) -> None:
    r = p.r
    kind = r.random()
    if kind < 0.09:
        p.block(r.choice(["h2", "h3", "h4"]), _phrase(r, 1, 7), 1)
    elif kind < 0.15:
        p.inside(r.choice(["ul", "ol"]), lambda: [p.block("li", _prose(r, 1, 25), 1) for _ in range(r.randint(1, 5))])
    elif kind < 0.19:
        p.inside("blockquote", lambda: p.block("p", _prose(r, 5, 50), 1)) if r.random() < 0.6 else p.block("blockquote", _prose(r, 3, 40), 1)
    elif kind < 0.21:
        p.block("pre", " ".join(_words(r, r.randint(2, 30))), 1)
    elif kind < 0.24:
        p.inside("table", lambda: [p.inside("tr", lambda: [p.block(r.choice(["td", "th"]), _phrase(r, 1, 6), 1) for _ in range(2)]) for _ in range(r.randint(1, 3))])
    elif kind < 0.27:
        p.inside("figure", lambda: p.block("figcaption", _prose(r, 3, 20), 1))
    elif kind < 0.29:
        p.inside("dl", lambda: [(p.block("dt", _phrase(r, 1, 3), 1), p.block("dd", _prose(r, 3, 20), 1)) for _ in range(r.randint(1, 3))])
    elif kind < 0.33 and not deep:
        p.inside(r.choice(["section", "div", 'div class="text"', 'div class="row comment-free"', 'section class="ads-free"']), lambda: [_part(p, 1) for _ in range(r.randint(1, 4))])
    else:
        _paragraph(p)


def _story(p: _Page, marked: bool) -> None:
    """The article; what stands between its parts is only told apart where names or links tell."""
    r = p.r
    if r.random() < 0.75:
        title = lambda: p.block(r.choice(["h1", "h1", "h2"]), _phrase(r, 1, 12), 1)
        p.inside("header", title) if marked and r.random() < 0.12 else title()
    for _ in range(1 if r.random() < 0.2 else r.randint(1, 11)):
        _part(p)
        if r.random() < 0.04:
            r.choice([_advert, _related, _form, _sharing])(p)


_ARTICLES = ["article", "article", "article", "main", 'div class="content"', 'div id="post-body"', 'div id="main-content"', 'div class="entry-content"', 'div class="story"',
             'article class="post type-post comments-open"', 'div itemprop="articleBody"', 'div id="content" class="has-sidebar"']


def _layout(p: _Page) -> None:
    r = p.r
    if r.random() < 0.05:  # nothing but text
        _paragraph(p)
        return
    before = [_menu, _top, _crumbs, _advert, _notice, _form, _aside, _more, _code, _code]
    after = [_aside, _related, _comments, _comments, _advert, _notice, _form, _sharing, _more, _code]
    for part in r.choices(before, k=r.choice([0, 0, 1, 1, 2, 3, 4])):
        part(p)
    kind = r.random()
    tail = r.random() < 0.2
    if kind < 0.68:
        end = lambda: [r.choice([_sharing, _comments, _related])(p)] if tail else None
        body = lambda: _story(p, True)
        holder = r.choice(_ARTICLES)
        if r.random() < 0.2:
            p.inside(r.choice(["main", 'div class="main"', 'div class="wrap no-sidebar"']), lambda: p.inside(holder, body, end))
        else:
            p.inside(holder, body, end)
    elif kind < 0.8:
        p.inside(r.choice(["div", "section", 'div class="wrap"', 'div class="col-8"', 'div id="page"']), lambda: _story(p, False))
    elif kind < 0.87:
        p.raw("<table><tr><td>")
        p.links(r.randint(2, 6))
        p.raw("</td><td>")
        _story(p, False)
        p.raw("</td></tr></table>")
    elif kind < 0.97:
        _story(p, False)
    for part in r.choices(after, k=r.choice([0, 0, 1, 1, 2, 3])):
        part(p)
    if r.random() < 0.7:
        _bottom(p)


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> list[tuple[str, list[int]]]:
    """n pages of mixed layouts with the label of each leaf block; those of more than 80 blocks are made anew."""
    r = random.Random(seed)
    out: list[tuple[str, list[int]]] = []
    while len(out) < n:
        p = _Page(r)
        if r.random() < 0.8:
            p.raw(r.choice(["<!DOCTYPE html>", ""]) + "<html><head><title>t</title></head>" + r.choice(["<body>", '<body class="page has-sidebar">', '<body id="content-page">']))
        _layout(p)
        p.raw("</body></html>" if r.random() < 0.7 else "")
        page = "".join(p.html)
        if len(p.labels) <= 80 and len(leaves(page)) == len(p.labels):
            out.append((page, p.labels))
    return out


_FITTED: dict[tuple[int, int], Field] = {}


def trained(n: int = TRAIN_PAGES, seed: int = 7) -> Field:
    """The field fitted to the labelled pages, once for each process."""
    if (n, seed) not in _FITTED:
        _FITTED[n, seed] = fit([(page_features(leaves(page)), labels) for page, labels in labelled_pages(n, seed)])
    return _FITTED[n, seed]


def extract_pages(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    model = model or trained()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [extract(h, model) for h in f["html"]]
            out = f[["page_id", "url"]].copy()
            out["page_id"] = pd.array([None if pd.isna(x) else int(x) for x in f["page_id"]], dtype="Int64")
            yield out.assign(text=text, n_chars=[len(t) for t in text])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
