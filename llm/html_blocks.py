"""Leaf blocks of a web page, with the tag path and the words that describe each."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

#: Widths of the hashed vectors: all ancestors, the two nearest ones, words.
PATH, NEAR, WORDS = 256, 64, 32

#: An attribute is a name, then maybe a quoted or bare value; a tag never ends inside a quoted value.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Fixed sets of element names.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr br object".split())
#: Formulas and drawings stand in the line of text around them; elements of both names are fixed sets as well.
_MATH = frozenset(
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts "
    "mprescripts mtable mtr mtd mstyle merror mpadded mphantom menclose maction".split())
_DRAWN = frozenset(
    "svg g path rect circle ellipse line polyline polygon text tspan textpath defs symbol use marker mask pattern clippath "
    "lineargradient radialgradient stop filter image foreignobject".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template title textarea select button iframe head annotation annotation-xml desc metadata".split())
#: Elements without shown text that do not end the line they stand in.
_QUIET = frozenset("annotation annotation-xml desc metadata title param".split())
_RAW = frozenset("script style title textarea noscript iframe".split())
#: Elements that end an open element of the named kinds.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}


@dataclass
class Block:
    path: int
    near: int
    text: str
    linked: int
    name: str


@dataclass
class _Open:
    name: str
    path: int
    own: int
    near: int


def _bits(tokens: list[str], width: int) -> int:
    mask = 0
    for token in tokens:
        mask |= 1 << zlib.crc32(token.encode()) % width
    return mask


_seen: dict[tuple[str, str], tuple[int, int]] = {}


def _described(name: str, attributes: str) -> tuple[int, int]:
    """Bits of an element for the path and for the near vector: its name and the words of class, id and role."""
    found = _seen.get((name, attributes))
    if found is None:
        values = [a or b or c for a, b, c in _NAMED.findall(attributes)]
        tokens = [name] + [w.lower() for value in values for w in _WORD.findall(value)]
        found = _bits(tokens, PATH), _bits(tokens, NEAR)
        if len(attributes) < 200:
            if len(_seen) > 50_000:
                _seen.clear()
            _seen[name, attributes] = found
    return found


def leaf_blocks(page: str) -> list[Block]:
    """Texts between block-level tags, in page order, without scripts, styles, comments and controls.

    Character references are decoded and white space is one space. Formulas, the text of drawings and the fallback
    of objects belong to the line they stand in; their titles, descriptions and source annotations are not shown
    and left out, as is ``noscript``, a notice to readers without scripts. Missing end tags are implied, a tag or
    comment that the page's end cuts off is dropped. The work grows with the page's length alone.
    """
    blocks: list[Block] = []
    stack = [_Open("", 0, 0, 0)]
    depth: dict[str, int] = {}
    pieces: list[str] = []
    linked = link = 0
    hidden = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                blocks.append(Block(top.path, top.near, text, linked, top.name))
            pieces.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal hidden
        while depth.get(name):
            gone = stack.pop()
            depth[gone.name] -= 1
            hidden -= gone.name in _HIDDEN
            if gone.name == name:
                return

    while at < size:
        found = _TAG.search(page, at)
        text = page[at:found.start() if found else size]
        if text and not hidden:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if link:
                linked += len(text)
        if not found:
            break
        at = found.end()
        end, name, attributes = found.group(1), found.group(2), found.group(3)
        if not name:
            continue
        name = name.lower()
        if name in _INLINE or name in _MATH or name in _DRAWN:
            if name == "a":
                link = 0 if end else 1
            elif name == "br":
                pieces.append(" ")
            continue
        quiet = name in _QUIET
        if not quiet and (not hidden or end and depth.get(name)):
            flush()
        if end:
            close(name)
            continue
        if not quiet:
            for other in (*_CLOSES.get(name, ()), "p"):
                close(other)
        if name in _VOID:
            continue
        link = 0
        path, near = _described(name, attributes or "")
        top = stack[-1]
        stack.append(_Open(name, top.path | path, near, top.own | near))
        depth[name] = depth.get(name, 0) + 1
        hidden += name in _HIDDEN
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else size
    flush()
    return blocks
