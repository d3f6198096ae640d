"""Leaf blocks of an HTML page: the runs of text between block-level tags, with the tags they stand in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of HTML: elements that end a run of text, that have no content, and whose content is no text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes "
    "noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead "
    "title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea noframes iframe".split())
#: Elements whose text stays in the run around them, which is marked with their names up to the next block-level tag.
EMBEDDED = frozenset("svg math canvas object".split())
#: What a select holds; any other block-level tag ends one that was not closed.
CHOICES = frozenset("option optgroup hr".split())
#: Elements that a new block-level tag closes.
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements closed by one of the same group, up to the list or table that holds them.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select".split())

#: Words that make a name one of a variant of what is named.
VARIANTS = frozenset("no not non without with has free less open closed enabled disabled show hide hides type status format".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>]++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|$)",
    re.S,
)
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Leaf:
    text: str
    tag: str
    path: tuple[str, ...]
    #: The words of class, id and role names of each element of the path.
    names: tuple[frozenset[str], ...]
    link_chars: int
    controls: int = 0
    embedded: frozenset[str] = frozenset()
    extra: dict = field(default_factory=dict)


def _names(attributes: str) -> frozenset[str]:
    """The words of the names that say what an element is; names of a variant, such as has-sidebar, say nothing."""
    found = [next(filter(None, m), "") for m in _NAMES.findall(attributes)] if attributes else []
    tokens = [[w.lower() for w in _WORD.findall(t)] for x in found for t in x.split()]
    return frozenset(w for t in tokens if VARIANTS.isdisjoint(t) for w in t)


def leaves(page: str | None) -> list[Leaf]:
    """The page's leaf blocks that have text, in order, white space folded and references decoded."""
    page = page or ""
    stack: list[tuple[str, frozenset[str], bool]] = []
    out: list[Leaf] = []
    pieces: list[str] = []
    links = anchors = controls = at = 0
    inside: set[str] = set()
    embedded: set[str] = set()

    def flush() -> None:
        nonlocal links, controls
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        if text and not any(hidden for _, _, hidden in stack):
            path = tuple(t for t, _, _ in stack)
            names = tuple(n for _, n, _ in stack)
            out.append(Leaf(text, path[-1] if path else "", path, names, min(links, len(text)), controls, frozenset(embedded)))
        pieces.clear()
        inside.clear()
        embedded.clear()
        links = controls = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            pieces.append(text)
            if inside and text.strip():
                embedded.update(inside)
            if anchors > 0:
                links += len(text.strip())

    def close(names: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not end:
            if tag in RAW and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if "svg" in inside:  # a drawing's title or style ends no run, nor, unclosed, the page
                    close_svg = re.compile("</svg", re.I).search(page, at)
                    if stop and not (close_svg and close_svg.start() < stop.start()):
                        at = stop.end()
                    continue
                if tag in BLOCK:
                    flush()
                at = stop.end() if stop else size
            elif tag in EMBEDDED:
                pieces.append("" if tag == "math" else " ")
                if not attributes.rstrip().endswith("/"):
                    inside.add(tag)
            elif tag in BLOCK:
                flush()
                if tag not in CHOICES:
                    close(("select",))
                if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                    stack.pop()
                if tag in SIBLINGS:
                    close(SIBLINGS[tag], HOLDERS)
                if tag not in VOID:
                    stack.append((tag, _names(attributes), bool(attributes) and _HIDDEN.search(attributes) is not None))
            elif tag == "br" or "svg" in inside and tag in ("text", "desc"):
                pieces.append(" ")
            elif tag == "a":
                anchors = 1
            elif tag in ("input", "label"):
                controls += 1
        elif tag in EMBEDDED:
            pieces.append("" if tag == "math" else " ")
            inside.discard(tag)
        elif tag in BLOCK:
            flush()
            anchors = 0 if tag != "a" else anchors
            close((tag,))
        elif tag == "a":
            anchors = 0
    flush()
    return out
