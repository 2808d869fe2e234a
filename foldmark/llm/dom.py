"""A small tolerant DOM: elements with their text, for pages of any size, in one pass."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<(/?)([a-zA-Z][^\s/><]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^<>=]|=)*+)>|<[!?][^<>]*+>""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")

#: Fixed values of HTML: elements without content, with raw content, and those that begin a block of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Only these hide what looks like markup up to their end tag; without one, scripts and styles go on to the end of the page.
RAW = frozenset("script style textarea title".split())
ENDLESS = frozenset("script style".split())
#: Their content is no text of the page; without an end tag only the start tag goes.
SKIPPED = frozenset("template iframe svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong "
    "sub sup time tt u var "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle mover munder munderover mfenced semantics annotation".split()
)
WITHIN = frozenset("noscript object select option optgroup datalist".split())  # blocks that may stand inside a paragraph
CLOSED_BY_BLOCK = "p"
ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
BOTH = {tag: re.compile(rf"<(/?){tag}\b[^>]*?(/?)>", re.I) for tag in SKIPPED}
LIKE = {"option": ("option",), "optgroup": ("option", "optgroup"), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table article section div main aside nav header footer form body html button select datalist object noscript".split())
CONTROLS = frozenset("input button select textarea".split())


@dataclass
class Node:
    """A block: its element, the blocks below it, and its own text with the part of it inside links."""

    tag: str
    tokens: frozenset[str]
    parent: Node | None
    children: list[Node] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    controls: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def attribute_tokens(attributes: str) -> frozenset[str]:
    """The words in class, id and role."""
    found = ATTRIBUTE.findall(attributes) if "=" in attributes else ()
    return frozenset(w for _, a, b, c in found for w in WORDS.findall((a or b or c).lower()))


class _Builder:
    """Open elements as (tag, block); inline elements share the block of what holds them."""

    def __init__(self) -> None:
        self.root = Node("html", frozenset(), None)
        self.open: list[tuple[str, Node]] = [("html", self.root)]
        self.loose: Node | None = None  # the anonymous block that takes text beside blocks
        self.count: Counter[str] = Counter()  # open elements by tag
        self.inside: list[Counter[str]] = [Counter()]  # the inline ones of them, per open block

    @property
    def links(self) -> int:
        return self.count["a"]

    def push(self, tag: str, node: Node) -> None:
        self.open.append((tag, node))
        self.count[tag] += 1
        if tag in INLINE:
            self.inside[-1][tag] += 1
        else:
            self.inside.append(Counter())

    def pop(self, to: int) -> None:
        for tag, _ in reversed(self.open[to:]):
            self.count[tag] -= 1
            if tag in INLINE:
                self.inside[-1][tag] -= 1
            else:
                self.inside.pop()
        del self.open[to:]
        self.loose = None

    def close(self, tags: tuple[str, ...], scope: frozenset[str] = SCOPE) -> None:
        """End the innermost open element of these tags unless an element of the scope is in between."""
        if not any(self.count[tag] for tag in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self.pop(i)
                return
            if self.open[i][0] in scope:
                return

    def start(self, tag: str, attributes: str) -> None:
        block = self.open[-1][1]
        if tag in INLINE:
            if tag == "a":
                self.close(("a",))
            self.push(tag, self.open[-1][1])
            return
        if tag in CONTROLS:
            block.controls += 1
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr"):
                self.add(" " if tag != "wbr" else "")
            return
        if tag not in WITHIN:
            self.close((CLOSED_BY_BLOCK,))
        self.close(LIKE.get(tag, ()))
        if tag in ("html", "body"):
            if tag == "body":
                self.root.tokens |= attribute_tokens(attributes)
            return
        while len(self.open) > 1 and self.open[-1][0] in INLINE:  # a block ends what inline elements left open
            self.pop(len(self.open) - 1)
        above = self.open[-1][1]
        node = Node(tag, attribute_tokens(attributes), above)
        above.children.append(node)
        self.push(tag, node)
        self.loose = None

    def end(self, tag: str) -> None:
        """End the innermost open element of this tag; inline ones end within their block only."""
        if not (self.inside[-1] if tag in INLINE else self.count)[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if tag in INLINE:
                    self.count[tag] -= 1
                    self.inside[-1][tag] -= 1
                    del self.open[i]
                else:
                    self.pop(i)
                return

    def add(self, text: str) -> None:
        """Text goes to an anonymous block in page order below the open one."""
        if self.loose is None:
            if not text.strip():
                return
            above = self.open[-1][1]
            self.loose = Node("#text", frozenset(), above)
            above.children.append(self.loose)
        self.loose.pieces.append(text)
        if self.links > 0:
            self.loose.linked += len(text)


def parse(page: str | None) -> Node:
    """The blocks of a page; scripts, styles, titles, text areas, frames, drawings, templates, comments and markup leave no text."""
    page = page or ""
    build, at = _Builder(), 0
    missing: set[str] = set()  # elements without an end tag from here on
    uneven: set[str] = set()  # elements that did not all end; from then on the first end tag counts
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            build.add(html.unescape(text) if "&" in text else text)
        if not m:
            return build.root
        at = m.end()
        if m[0] == "<!--":
            stop = COMMENT_END.search(page, m.start() + 2)
            at = stop.end() if stop else len(page)
            continue
        if m[0] == "<![CDATA[":
            stop = page.find("]]>", at) if "]]>" not in missing else -1
            if stop < 0:
                missing.add("]]>")
                stop = page.find(">", at)
                at = len(page) if stop < 0 else stop + 1
            else:
                at = stop + 3
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            build.end(tag)
        elif tag in RAW or tag in SKIPPED:
            if (m[3] or "").endswith("/"):
                continue
            build.open[-1][1].controls += tag in CONTROLS
            stop = -1
            if tag not in missing:
                stop = _past(tag, page, at, uneven) if tag in SKIPPED else getattr(ENDS[tag].search(page, at), "end", lambda: -1)()
            if stop >= 0:
                at = stop
            elif tag in ENDLESS:
                at = len(page)
            else:
                missing.add(tag)
        else:
            build.start(tag, m[3] or "")


def _past(tag: str, page: str, at: int, uneven: set[str]) -> int:
    """Where an element ends that may hold others of its kind; -1 without an end tag."""
    depth, first = 1, -1
    for m in BOTH[tag].finditer(page, at):
        if m[1]:
            depth -= 1
            first = m.end() if first < 0 else first
        elif not m[2]:
            depth += 1
        if not depth or (first >= 0 and tag in uneven):
            return m.end() if not depth else first
    if first >= 0:
        uneven.add(tag)
    return first
