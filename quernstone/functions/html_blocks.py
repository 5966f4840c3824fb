"""HTML to plain text by way of a tree of boxes.

The source is cut into lexemes, the lexemes into a tree of blocks, lists and items (all else is
inline), the tree into a flat row of marks, and the marks into lines.  Each step is linear.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

#: How elements are laid out (fixed values); all others are inline.
LISTS = frozenset("ul ol menu dir".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend main nav p pre section summary table tbody tfoot thead tr".split())
WITHOUT_TEXT = ("script", "style", "title", "svg", "noscript", "template", "textarea", "iframe")

_LEXEME = re.compile(
    rf"""
    (?P<hidden> <!--.*?(?:-->|\Z) | <[!?][^>]*+(?:>|\Z) | </(?![A-Za-z])[^>]*+(?:>|\Z) )
  | (?P<end> < (?P<closing>/?) (?P<name>[A-Za-z][^\s/>]*+) [^>=]*+ (?: = [\t\n\f\r ]*+ (?: "[^"]*+" | '[^']*+' | (?!["']) ) [^>=]*+ )*+ > )
  | (?P<unfinished> </?[A-Za-z] )
  | (?P<text> <? [^<]++ | < )
    """,
    re.S | re.X,
)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in WITHOUT_TEXT}


def _lexemes(source: str) -> Iterator[re.Match]:
    """Tags and text; what holds no text is passed over and an unfinished tag ends the text."""
    at = 0
    while (m := _LEXEME.match(source, at)) and not m["unfinished"]:
        at = m.end()
        if m["hidden"]:
            continue
        yield m
        if m["end"] and not m["closing"] and (ends := _ENDS.get(m["name"].lower())) and source[at - 2] != "/":
            closed = ends.search(source, at)
            at = closed.start() if closed else len(source)


@dataclass
class Box:
    """An element that is not inline: its kind (root, block, list or item), name, and content in order."""

    kind: str
    name: str = ""
    content: list[Box | str] = field(default_factory=list)


#: Leaves of the tree besides text.
BREAK, EDGE = "\x00br", "\x00edge"


def tree(source: str) -> Box:
    """The boxes of a page.  A box left open ends with the one around it; a stray end is an edge between blocks."""
    open_ = [Box("root")]

    def innermost(matches, within: str) -> int:
        """Depth of the innermost open box that ``matches``, none beyond a box whose kind is in ``within``; 0 if none."""
        for depth in range(len(open_) - 1, 0, -1):
            if matches(open_[depth]):
                return depth
            if open_[depth].kind in within:
                break
        return 0

    def enter(kind: str, name: str) -> None:
        open_[-1].content.append(box := Box(kind, name))
        open_.append(box)

    def leave(depth: int) -> None:
        if depth:
            del open_[depth:]

    for m in _lexemes(source):
        if m["text"]:
            open_[-1].content.append(html.unescape(m["text"]).replace("\0", ""))
            continue
        name, closing = m["name"].lower(), bool(m["closing"])
        if name == "br":
            open_[-1].content.append(BREAK)
        elif name in ("td", "th"):
            open_[-1].content += [] if closing else [" "]
        elif name == "li":
            leave(innermost(lambda b: b.kind == "item", "list"))
            if not closing:
                enter("item", name)
        elif name in LISTS or name in BLOCKS:
            if not closing and name != "hr":
                enter("list" if name in LISTS else "block", name)
            elif depth := innermost(lambda b: b.kind == "list" if name in LISTS else b.name == name, "" if name in LISTS else "list item"):
                leave(depth)
            else:
                open_[-1].content.append(EDGE)
    return open_[0]


#: Marks of the flat form: a gap is at least so many line ends, a step is one more up to two.
GAP, STEP, BULLET, TEXT = "gap", "step", "bullet", "text"


def marks(root: Box) -> Iterator[tuple[str, int | str]]:
    """The tree from left to right; blocks are a blank line apart, within an item a line."""
    todo: list[tuple[Box | str | tuple[str, int], int]] = [(root, 2)]
    while todo:
        node, gap = todo.pop()
        if isinstance(node, tuple):
            yield node
        elif isinstance(node, str):
            yield (STEP, 1) if node is BREAK else (GAP, gap) if node is EDGE else (TEXT, node)
        else:
            inside = 1 if node.kind == "item" else gap
            edges = {"root": (), "item": ((GAP, 1), (BULLET, 1))}.get(node.kind, ((GAP, gap),))
            todo += [((GAP, gap), gap)] if node.kind in ("block", "list") else []
            todo += [(child, inside) for child in reversed(node.content)]
            todo += [(edge, gap) for edge in reversed(edges)]


def _wider(gap: int, mark: tuple[str, int | str]) -> int:
    kind, n = mark
    return max(gap, int(n)) if kind == GAP else min(gap + 1, 2) if kind == STEP else gap


def lines(root: Box) -> Iterator[tuple[int, bool, str]]:
    """(line ends before it, whether it opens an item, text) of each line that holds any."""
    gap, bullet = 0, False
    for is_text, group in groupby(marks(root), key=lambda mark: mark[0] == TEXT):
        if not is_text:
            between = list(group)
            gap = reduce(_wider, between, gap)
            bullet |= any(kind == BULLET for kind, _ in between)
        elif text := " ".join("".join(str(t) for _, t in group).split()):
            yield gap, bullet, text
            gap, bullet = 0, False


def text_of_html(source: str) -> str:
    """Plain text of HTML: blocks apart by a blank line, list items behind dashes, entities decoded in text only."""
    text = "".join("\n" * gap + "- " * bullet + line for gap, bullet, line in lines(tree(source)))
    return unicodedata.normalize("NFC", text.strip())
