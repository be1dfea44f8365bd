"""Leaf blocks of an HTML page, with the elements around them.

One pass over the page, linear in its length whatever the markup looks like: a tag
that never ends is read up to its first ``>``, unclosed elements end with what holds
them, end tags without a start are left out, and elements and features above a block
are carried along instead of walked for each block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# HTML's element names by how they are read.
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
HIDDEN = frozenset(
    ["head", "template", "svg", "math", "object", "canvas", "audio", "video", "select", "noscript"]
)
BLOCK = frozenset(
    ["address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd"]
    + ["details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer"]
    + ["form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "label", "legend"]
    + ["li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table"]
    + ["tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
)
VOID = frozenset(["hr", "img", "input", "br", "meta", "link", "source", "wbr", "area", "col"])
# An open element that a start tag ends, with the elements that keep it open.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)),
}
SECTIONS = frozenset(
    ["article", "main", "section", "nav", "aside", "header", "footer", "form", "figure", "table"]
    + ["ul", "ol", "dl", "blockquote", "dialog", "address", "button", "label", "details", "menu"]
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
_NAMING = re.compile(
    r"(?<![\w:-])(class|id|role|itemprop)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)", re.IGNORECASE
)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile("[a-z]+")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_END_OF_RAW = {name: re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE) for name in RAW}
NAME_LETTERS = 5


def decoded(text: str) -> str:
    """Character references resolved, white space as single blanks, trimmed."""
    if "&" in text:
        text = html.unescape(_LONG_NUMBER.sub("\N{REPLACEMENT CHARACTER}", text))
    return " ".join(text.split())


def names_of(attributes: str) -> list[str]:
    """First letters of the words in class, id, role and itemprop."""
    found = []
    for _, value in _NAMING.findall(attributes):
        found += [w[:NAME_LETTERS] for w in _LETTERS.findall(_HUMP.sub(" ", value).lower())]
    return found


@dataclass
class Block:
    """A run of text with nothing but inline markup inside."""

    text: str
    tag: str
    around: frozenset[str]  # features of the elements around it
    linked: int  # letters inside links


@dataclass
class Element:
    tag: str
    around: frozenset[str]
    hidden: bool


@dataclass
class Reader:
    """The open elements, and the block being read."""

    known: frozenset[str] | None = None  # features that matter; None for all
    stack: list[Element] = field(default_factory=lambda: [Element("", frozenset(), False)])
    open: Counter = field(default_factory=Counter)
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    link_at: int | None = None  # depth of the link that is open
    linked: int = 0

    def text(self, piece: str) -> None:
        if piece and not self.stack[-1].hidden:
            self.pieces.append(piece)
            if self.link_at is not None:
                self.linked += len(piece)

    def end_block(self) -> None:
        if self.pieces:
            text = decoded("".join(self.pieces))
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, top.tag, top.around, min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def push(self, tag: str, attributes: str) -> None:
        self.end_block()
        above = self.stack[-1]
        own = [f"in:{tag}"] if tag in SECTIONS else []
        if attributes:
            own += [f"name:{name}" for name in names_of(attributes)]
        around = above.around
        if own:
            around = frozenset(f for f in around if not f.startswith("near:"))
            own += [f"near:{f}" for f in own]
            if self.known is not None:
                own = [f for f in own if f in self.known]
            around = around.union(own)
        self.stack.append(Element(tag, around, above.hidden or tag in HIDDEN))
        self.open[tag] += 1

    def pop_to(self, tag: str) -> None:
        """End the innermost open element of this name and all inside it."""
        self.end_block()
        while True:
            ended = self.stack.pop()
            self.open[ended.tag] -= 1
            if ended.tag == tag:
                break
        if self.link_at is not None and len(self.stack) < self.link_at:
            self.link_at = None

    def end_implied(self, tag: str) -> None:
        """End what a start tag ends without an end tag."""
        if self.open["head"]:
            self.pop_to("head")
        if self.open["p"] and tag not in ("button", "label"):
            self.pop_to("p")
        ended, kept_by = ENDS.get(tag, ((), ()))
        if any(self.open[name] for name in ended):
            for element in reversed(self.stack):
                if element.tag in ended:
                    self.pop_to(element.tag)
                    break
                if element.tag in kept_by:
                    break

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            if self.link_at is None:
                self.link_at = len(self.stack)
        elif tag in ("br", "wbr", "img", "input"):
            self.text(" " if tag != "wbr" else "")
        elif tag == "hr":
            self.end_implied(tag)
            self.end_block()
        elif tag in HIDDEN:
            self.push(tag, "")
        elif tag in BLOCK:
            self.end_implied(tag)
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_at = None
        elif self.open[tag] > 0:
            self.pop_to(tag)


def blocks_of(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks with text in page order."""
    reader, at, plain = Reader(known), 0, False
    last = page.rfind(">")
    while True:
        mark = page.find("<", at)
        if mark < 0:
            reader.text(page[at:])
            break
        reader.text(page[at:mark])
        follower = page[mark + 1 : mark + 2]
        if follower == "!" or follower == "?":
            comment = page.startswith("<!--", mark)
            end = page.find("-->", mark + 2) if comment else page.find(">", mark)
            if end < 0:  # a comment that never ends is one to the end
                break
            at = end + (3 if comment else 1)
            continue
        closing = follower == "/"
        name = _NAME.match(page, mark + 1 + closing)
        if not name:
            if closing and mark < last:  # such a tag is a comment
                at = page.find(">", mark) + 1
            else:
                reader.text("<")
                at = mark + 1
            continue
        if mark > last:  # a tag that never ends
            break
        rest = None if plain else _REST.match(page, name.end())
        if rest is None:  # an open quote up to the end: from now on the next > ends a tag
            plain = True
            end = page.find(">", name.end()) + 1
            if not end:
                break
        else:
            end = rest.end()
        tag, at = name[0].lower(), end
        if closing:
            reader.end(tag)
        elif tag in RAW:
            ended = _END_OF_RAW[tag].search(page, end)
            if ended is None:
                break
            at = ended.start()
        elif page[end - 2] != "/" or tag in BLOCK:
            reader.start(tag, page[name.end() : end - 1])
        elif tag in VOID:
            reader.start(tag, "")
    reader.end_block()
    return reader.blocks
