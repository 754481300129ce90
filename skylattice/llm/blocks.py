"""HTML to leaf blocks: one pass of a tolerant tokenizer, no tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Element names by their part in layout (fixed values of HTML).
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot
th thead tr ul""".split())
UNSEEN = frozenset("head iframe math noembed noframes noscript object script style svg template title".split())
FOREIGN = frozenset({"svg", "math"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag ends an open element of these names, if that is nearer than a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINER = frozenset("ul ol dl menu table select div section article main body nav aside footer header form".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*>? | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*+(?:(?:"[^"]*"|'[^']*'|["'])[^>"']*+)*+)>?""",
    re.S | re.X,
)
_ATTR = re.compile(r"""(class|id|role|style|aria-label|itemprop|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+|\d+")
_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in UNSEEN}


@dataclass
class Leaf:
    path: tuple[str, ...]  # features of the open elements, outermost first
    text: str
    linked: int  # characters inside links


def _names(name: str, attrs: str) -> str:
    """Feature words of an element: its name, and the words of what it calls itself."""
    out = [name]
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("@hidden")
        elif key != "style":
            out += ["." + w for w in _PART.findall(value)]
    return " ".join(out)


def leaves(page: str | None) -> list[Leaf]:
    """Blocks of text of a page in order. A block ends where a block element starts or ends; inline
    elements and line breaks do not end it. References are decoded, blanks become one space."""
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0
    endless: set[str] = set()  # names without an end tag from here on, which is looked for once
    page = page or ""

    def end_block() -> None:
        nonlocal linked
        raw = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append(Leaf(tuple(f for _, f in stack), text, linked))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if in_link:
            linked += len(raw)

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in UNSEEN:
            empty = name in FOREIGN and (m["attrs"] or "").rstrip().endswith("/")  # elsewhere the slash means nothing
            if not m["close"] and not empty and name not in endless:
                end = _END[name].search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else len(page) if name in ("script", "style", "template", "title") else at
        elif name == "br":
            add(" ")
        elif name == "a":
            in_link = 0 if m["close"] else 1
        elif name in BLOCK:
            end_block()
            in_link = 0
            if m["close"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name not in VOID:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                ends = CLOSES.get(name, ())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in CONTAINER:
                        break
                stack.append((name, _names(name, m["attrs"])))
    end_block()
    return out
