"""Problem 4: markup residue to clean text, without a site's recurring template parts.

A text is cut into elements: HTML elements with what they hold, or blocks of Markdown, wiki and
LaTeX source.  Every element's subtree is hashed, the hashes are counted per host in Spark over
texts that differ, and subtrees that recur across many pages of a host are deleted before the rest
is written out as plain text in which headings, lists, tables, code and formulas can still be told.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .repeats import once

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

#: A subtree is a template's if it stands on so many different pages of a host, and on such a share of them.
MIN_PAGES, MIN_SHARE = 5, 0.3

#: Elements of HTML (fixed values); other words in angle brackets are text.
ELEMENTS = frozenset("a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style title svg noscript template head".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form header hr html main nav ol p pre section summary table tbody tfoot thead tr ul".split())
_FLAGS = "allowfullscreen async autofocus autoplay checked controls default defer disabled hidden loop multiple muted nowrap open readonly required reversed selected"

_ATTRIBUTES = rf"(?:\s+(?:[A-Za-z_:@][\w:.@-]*\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>=`]+)|{_FLAGS.replace(' ', '|')}))*"
_TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)({_ATTRIBUTES})\s*(/?)>")
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^<>]*>|<!\[CDATA\[.*?\]\]>|<\?xml[^<>]*\?>", re.S | re.I)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPED_TAG = re.compile(rf"&lt;/?([A-Za-z][A-Za-z0-9]*)(?:\s(?:(?!&[lg]t;|[<>]).)*)?/?&gt;", re.S)

_FENCE = re.compile(r"^(```+|~~~+)[^\n`]*\n.*?(?:^\1\s*$|\Z)", re.S | re.M)
_ATX = re.compile(r"^(?:> ?)*(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
_SETEXT = re.compile(r"^(?!\s*[-•*+>|])(\S.*)\n(={3,}|-{3,})[ \t]*$", re.M)
#: What stands between the signs of inline markup: it may go on in the next line, but not in the next paragraph.
_SAME = r"\n(?![ \t]*\n)"
_RUN = re.compile(r"\*+|_+|\n[ \t]*\n")
_LINK = re.compile(rf"!?\[((?:[^\[\]\n]|{_SAME})*)\]\(([^()\s]*(?:\([^()\s]*\))?[^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
_CODE = re.compile(rf"(?<!`)(`{{1,2}})(?!`)((?:[^`\n]|{_SAME})+)\1(?!`)")
_QUOTE = re.compile(r"^> ?", re.M)
_RULE_ROW = re.compile(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", re.M)
_STRIKE = re.compile(rf"~~(?=\S)((?:[^~\n]|{_SAME})+)(?<=\S)~~")

_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_BOLD = re.compile(rf"(?<!')('{{2,3}}|'{{5}})(?!')(?=\S)((?:[^'\n]|'(?!')|{_SAME})*?)(?<=[^\s'])\1(?!')")
_WIKI_LINK = re.compile(rf"\[\[((?:[^\[\]\n|]|{_SAME})+)(?:\|((?:[^\[\]\n]|{_SAME})*))?\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]+\}\}")
_WIKI_TABLE = re.compile(r"^\{\|.*?^\|\}", re.S | re.M)
_WIKI_HIDDEN = ("category", "file", "image")

_BEGIN_END = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{")
_NAME_OR_BRACE = re.compile(r"\\([A-Za-z]+)\*?|[{}]")
_OPTION = re.compile(r"\\([A-Za-z]+)\*?\[")
_OPTION_END = re.compile(r"[\]\n]")
_HEADS = {"title": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_MATH = re.compile(r"\$\$?(?=[^\s$])([^$\n]*?(?:\\[A-Za-z]+|[_^]\{?\w)[^$\n]*?)(?<=[^\s$])\$\$?|\\\(((?:(?!\\\().)+?)\\\)|\\\[((?:(?!\\\[).)+?)\\\]", re.S)
_BARE = re.compile(r"\\(?:item|section|subsection|paragraph|maketitle|newline|noindent|par|hline|centering|ldots|LaTeX|TeX)\b")
_MATH_ENVIRONMENTS = frozenset("equation align gather multline displaymath math eqnarray".split())
_VERBATIM = frozenset("verbatim lstlisting".split())

#: Signs that stand for structure until a text is done; they are taken out of sources first.
_KEPT, _HEAD, _FENCED, _DASH = "\x00", "\x01", "\x02", "\x03"
_SIGNS = {_HEAD: "#", _FENCED: "```", _DASH: "-"}


def _tags(text: str) -> list[re.Match]:
    return [m for m in _TAG.finditer(text) if m[2].lower() in ELEMENTS]


def _references(text: str) -> bool:
    return any(html.unescape(m[0]) != m[0] for m in _REFERENCE.finditer(text))


def kinds_of(text: str) -> list[str]:
    """Which of html, markdown, wiki and latex a text holds."""
    found = set()
    plain = text
    if "&" in text and _references(text):
        found.add(HTML)
        plain = html.unescape(text) if any(m[1].lower() in ELEMENTS for m in _ESCAPED_TAG.finditer(text)) else text
    if "<" in plain and (_COMMENT.search(plain, 0, _comments_end(plain)) or _tags(plain)):
        found.add(HTML)
        plain = _without_comments(plain, " ")
        plain = _TAG.sub(lambda m: " " if m[2].lower() in ELEMENTS else m[0], plain)
    if "\\" in plain and (_environments(plain)[1] or _COMMAND.search(plain) or _MATH.search(plain) or _BARE.search(plain)):
        found.add(LATEX)
    elif "$" in plain and _MATH.search(plain):
        found.add(LATEX)
    if ("==" in plain and _WIKI_HEAD.search(plain)) or ("''" in plain and _WIKI_BOLD.search(plain)) or ("[[" in plain and _WIKI_LINK.search(plain)) or ("{{" in plain and _WIKI_TEMPLATE.search(plain)) or "{|" in plain and _WIKI_TABLE.search(plain, 0, plain.rfind("\n|}") + 3):
        found.add(WIKI)
    sourced = _MATH.sub(" ", _environments(plain, lambda name, numbers, text: " ")[0]) if LATEX in found else plain
    if any(p.search(sourced) for p, c in ((_ATX, "#"), (_SETEXT, "\n"), (_LINK, "]("), (_CODE, "`"), (_FENCE, ""), (_RULE_ROW, "|"), (_QUOTE, ">"), (_STRIKE, "~~")) if c in sourced) or ("*" in sourced or "_" in sourced) and _unstressed(sourced) != sourced:
        found.add(MARKDOWN)
    return sorted(found)


def _comments_end(text: str) -> int:
    """Where the last comment or the like that ends does so: no search needs to look beyond."""
    return text.rfind(">") + 1


def _without_comments(text: str, instead: str) -> str:
    out, at, last = [], 0, {}
    for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
        last[opening] = text.rfind(closing)
    for m in re.finditer(r"<!--|<!\[CDATA\[|<!DOCTYPE[^<>]*>|<\?xml[^<>]*\?>", text, re.I):
        if m.start() < at:
            continue
        end = m.end()
        if m[0].upper() in last:
            if last[m[0].upper()] < end:
                continue
            closing = "-->" if m[0] == "<!--" else "]]>"
            end = text.index(closing, end) + 3
        out += [text[at : m.start()], instead]
        at = end
    return "".join(out) + text[at:]


@dataclass
class Element:
    """A node of the page: text pieces and elements in order, and once ``hashed`` the hash of the subtree."""

    name: str
    parts: list = field(default_factory=list)
    own: int = 0


def hashed(page: Element) -> list[int]:
    """Hashes every subtree, innermost first; the hashes of those that hold anything, without the page's."""
    order, todo = [], [page]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Element)]
    out = []
    for node in reversed(order):
        h = xxhash.xxh3_64(node.name)
        holds = False
        for p in node.parts:
            inner = isinstance(p, Element)
            text = str(p.own) if inner else " ".join(p.split())
            holds |= inner or bool(text)
            h.update(f"\0{text}".encode("utf-8", "surrogatepass"))
        node.own = h.intdigest() - (1 << 63)
        if holds and node is not page:
            out.append(node.own)
    return out


def tree(text: str, kinds: list[str]) -> Element:
    """The page as elements; source blocks between blank lines are elements too."""
    if HTML in kinds and any(m[1].lower() in ELEMENTS for m in _ESCAPED_TAG.finditer(text)):
        text = html.unescape(text)
    page = Element("#page")
    if HTML in kinds:
        stack, open_, at = [page], Counter(), 0
        text = _without_comments(text, "")

        def close(name: str) -> None:
            while stack[-1].name != name:
                open_[stack.pop().name] -= 1
            open_[stack.pop().name] -= 1

        for m in _tags(text):
            closing, name = m[1], m[2].lower()
            if m.start() > at:
                stack[-1].parts.append(html.unescape(text[at : m.start()]))
            at = m.end()
            if closing:
                if open_[name]:
                    close(name)
                continue
            if name in ("li", "p", "tr", "td", "th", "dt", "dd") and stack[-1].name == name:
                close(name)
            new = Element(name)
            stack[-1].parts.append(new)
            if name not in _VOID and not m[4]:
                stack.append(new)
                open_[name] += 1
        stack[-1].parts.append(html.unescape(text[at:]))
        return page
    at = 0
    for m in _FENCE.finditer(text) if MARKDOWN in kinds else ():
        page.parts += [Element("#block", [b]) for b in _blank_lines(text[at : m.start()])] + [Element("#fence", [m[0]])]
        at = m.end()
    page.parts += [Element("#block", [b]) for b in _blank_lines(text[at:])]
    return page


def _blank_lines(text: str) -> list[str]:
    return [b for b in re.split(r"\n[ \t]*\n", text) if b.strip()]


def _write(page: Element, drop: set[int], kept: list[str]) -> tuple[str, int]:
    """The text of a page, and how many subtrees were left out.  Preformatted text goes to ``kept``."""
    if drop:
        hashed(page)
    out: list[str] = []
    gone = 0
    numbers: list[int] = []  # of each open list: its last number, -1 if its items have none
    todo: list = [(page, "#page")]
    while todo:
        p, inside = todo.pop()
        if isinstance(p, str):
            out.append(p if inside[0] == "#" else re.sub(r"\s+", " ", p))
            continue
        if not isinstance(p, Element):
            p(out, numbers)
            continue
        if drop and p.own in drop:
            gone += 1
            continue
        name = p.name
        if name in _SKIPPED:
            continue
        if name == "br":
            out.append("\n")
            continue
        if name == "pre":
            kept.append(_all_text(p).strip("\n"))
            out.append(f"\n\n{_FENCED}\n{_KEPT}{len(kept) - 1}{_KEPT}\n{_FENCED}\n\n")
            continue
        before, after = _edges(name)
        todo.append((after, name))
        todo += [(child, name) for child in reversed(p.parts)]
        todo.append((before, name))
    return "".join(out), gone


def _all_text(node: Element) -> str:
    out, todo = [], [node]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.name == "br":
            out.append("\n")
        elif p.name not in _SKIPPED:
            todo += reversed(p.parts)
    return "".join(out)


def _edges(name: str) -> tuple:
    """What is written before and after an element."""
    if re.fullmatch("h[1-6]", name):
        return (lambda out, n: out.append(f"\n\n{_HEAD * int(name[1])} ")), (lambda out, n: out.append("\n\n"))
    if name == "li":

        def item(out: list[str], numbers: list[int]) -> None:
            if numbers and numbers[-1] >= 0:
                numbers[-1] += 1
                out.append(f"\n{numbers[-1]}. ")
            else:
                out.append(f"\n{_DASH} ")

        return item, lambda out, n: out.append("\n")
    if name in ("ul", "ol"):
        return (lambda out, n: (out.append("\n"), n.append(0 if name == "ol" else -1))), (lambda out, n: (out.append("\n"), n.pop()))
    edge = "\n" if name in ("tr", "tbody", "thead") else "\n\n" if name in _BLOCKS or name in ("#block", "#fence") else ""
    return (lambda out, n: out.append(edge)), (lambda out, n: out.append("\t" if name in ("td", "th") else edge))


def _balanced(text: str) -> bool:
    depth = 0
    for c in re.findall("[{}]", text):
        depth += 1 if c == "{" else -1
        if depth < 0:
            return False
    return not depth


def _command_before(out: list[str]) -> tuple[int, str] | None:
    """Start and name of the command whose brace would open after ``out``."""
    at = len(out)
    if at and out[at - 1] == "]":
        lo = at - 1
        while lo and out[lo - 1] not in "]\n":
            lo -= 1
        m = _OPTION.search("".join(out[lo : at - 1]))
        return (lo + m.start(), m[1]) if m else None
    at -= bool(at and out[at - 1] == "*")
    end = at
    while at and out[at - 1].isascii() and out[at - 1].isalpha():
        at -= 1
    return (at - 1, "".join(out[at:end])) if at < end and at and out[at - 1] == "\\" else None


def _unwrapped(text: str) -> str:
    r"""What all commands hold, as if the first \cmd{...} were unwrapped until none is left, in one pass."""
    out: list[str] = []  # characters
    open_: list[list] = []  # groups: where in out they begin, and what their closing brace becomes
    at, stop, odd = 0, -1, -1

    def enter(name: str) -> None:
        level = _HEADS.get(name, 0)
        out.extend(f"\n\n{_HEAD * level} " if level else "")
        open_.append([len(out), "\n\n" if level else ""])

    while m := _NAME_OR_BRACE.search(text, at):
        out += text[at : m.start()]
        at = end = m.end()
        if m[1]:
            if text.startswith("[", end):
                if stop <= end:  # the first character that ends an option from here on
                    stop = s.start() if (s := _OPTION_END.search(text, end + 1)) else len(text)
                # an option that holds half a group is left to the brace behind it
                if text.startswith("]{", stop) and stop != odd:
                    if _balanced(text[end + 1 : stop]):
                        end = stop + 1
                    else:
                        odd = stop
            if text.startswith("{", end):
                enter(m[1])
                at = end + 1
            else:
                out += m[0]
        elif m[0] == "}":
            out += open_.pop()[1] if open_ else "}"
        elif before := _command_before(out):  # put together by what was unwrapped
            start, name = before
            for group in reversed(open_ if out[-1] == "]" else ()):  # groups begun in its option
                if group[0] <= start:
                    break
                group[:] = start, "}"
            del out[start:]
            enter(name)
        else:
            open_.append([len(out), "}"])
            out.append("{")
    out += text[at:]
    for _, closing in reversed(open_):
        out += closing.strip("}")
    return "".join(out)


def _environments(text: str, write: Callable[[str, list[int], str], str] | None = None) -> tuple[str, bool]:
    """The text with each whole environment as ``write`` (name, number of its last item, inner text) gives it, innermost first, and whether there is one."""
    out: list[str] = []
    open_: list[tuple[str, int]] = []  # name, where in out it begins
    names: Counter = Counter()
    found, at = False, 0
    for m in _BEGIN_END.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[1] == "begin":
            open_.append((m[2], len(out)))
            names[m[2]] += 1
        elif names[m[2]]:
            found = True
            if write is None:
                break
            name = ""
            while name != m[2]:  # those that never end are text
                name, begun = open_.pop()
                names[name] -= 1
            inner = "".join(out[begun + 1 :])
            del out[begun:]
            out.append(write(name, [0], inner))
            continue
        out.append(m[0])
    return "".join(out) + text[at:], found


def _latex(text: str, kept: list[str]) -> str:
    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"{_KEPT}{len(kept) - 1}{_KEPT}"

    def environment(name: str, number: list[int], inner: str) -> str:
        plain = name.rstrip("*")
        if plain in _MATH_ENVIRONMENTS:
            kept.append(f"\\begin{{{name}}}{_given_back(inner, kept)}\\end{{{name}}}")
            return f"\n{_KEPT}{len(kept) - 1}{_KEPT}\n"
        if plain in _VERBATIM:
            kept.append(_given_back(inner, kept).strip("\n"))
            return f"\n{_FENCED}\n{_KEPT}{len(kept) - 1}{_KEPT}\n{_FENCED}\n"

        def item(_: re.Match) -> str:
            number[0] += 1
            return f"\n{number[0]}. " if plain == "enumerate" else f"\n{_DASH} "

        return re.sub(r"\\item\b\s*", item, inner)

    text = _environments(text, environment)[0]
    text = _MATH.sub(keep, text)
    text = re.sub(r"~?\\(?:cite|ref|label|eqref|footnotemark)[A-Za-z]*\*?(?:\[[^\[\]\n]*\])?\{[^{}]*\}", "", text)
    text = _unwrapped(text)
    return _BARE.sub("", text)


def _given_back(text: str, kept: list[str]) -> str:
    """With what was put aside, which may hold more that was."""
    return re.sub(f"{_KEPT}(\\d+){_KEPT}", lambda m: _given_back(kept[int(m[1])], kept[: int(m[1])]), text)


def _wiki(text: str, kept: list[str], markdown: bool) -> str:
    text = _WIKI_TEMPLATE.sub("", text)
    text = _WIKI_HEAD.sub(lambda m: f"\n\n{_HEAD * len(m[1])} {m[2].strip()}\n\n", text)
    text = _WIKI_LINK.sub(lambda m: "" if m[1].split(":")[0].strip().lower() in _WIKI_HIDDEN and ":" in m[1] else m[2] if m[2] is not None else m[1], text)
    number = 0
    out = []
    for line in text.split("\n"):
        # with Markdown about, a sign that no blank follows is emphasis and "# " a heading
        m = re.match(r"([*#]+)[ \t]+(?=\S)" if markdown else r"([*#]+)[ \t]*(?=\S)", line)
        ordered = bool(m) and m[1].endswith("#")
        if ordered and markdown:
            m, ordered = None, False
        number = number + 1 if ordered else 0
        out.append((f"{number}. " if ordered else f"{_DASH} ") + line[m.end() :] if m else line)
    return _WIKI_BOLD.sub(lambda m: m[2], "\n".join(out))


def _unstressed(text: str) -> str:
    """Without the signs of emphasis, however deep: each closing run takes from the nearest opening run of its sign."""
    out: list[str] = []
    open_: list[tuple[int, str]] = []  # where in out an opening run stands
    waiting: Counter = Counter()
    at = 0
    for m in _RUN.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        run, sign = m[0], m[0][0]
        if sign == "\n":
            open_, waiting = [], Counter()
            out.append(run)
            continue
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 2]
        joined = lambda c: c.isalnum() or c == "_"
        inside_name = sign == "_" and after[:1] == "." and joined(after[1:])
        left = run
        if len(run) <= 3 and before.strip() and not joined(after[:1]) and not inside_name:
            while left and waiting[sign]:
                place, opened = open_.pop()
                waiting[opened] -= 1
                if opened != sign:
                    continue
                n = min(len(left), len(out[place]))
                left, out[place] = left[n:], out[place][n:]
                if out[place]:
                    open_.append((place, sign))
                    waiting[sign] += 1
        out.append(left)
        if left == run and len(run) <= 3 and after[:1].strip() and not (before and joined(before)):
            open_.append((len(out) - 1, sign))
            waiting[sign] += 1
    return "".join(out) + text[at:]


def _markdown(text: str, kept: list[str]) -> str:
    def keep(inner: str) -> str:
        kept.append(inner)
        return f"{_KEPT}{len(kept) - 1}{_KEPT}"

    text = _FENCE.sub(lambda m: f"{_FENCED}\n{keep(chr(10).join(m[0].split(chr(10))[1:]).rstrip().removesuffix(m[1]).rstrip(chr(10)))}\n{_FENCED}\n", text)
    text = _CODE.sub(lambda m: keep(m[2]), text)
    text = _QUOTE.sub("", text)
    text = _RULE_ROW.sub("", text)
    text = _SETEXT.sub(lambda m: f"\n\n{_HEAD * (1 if m[2][0] == '=' else 2)} {m[1]}\n\n", text)
    text = _ATX.sub(lambda m: f"\n\n{_HEAD * len(m[1])} {m[2]}\n\n", text)
    text = re.sub(r"^([ \t]*)[*+][ \t]+(?=\S)", rf"\1{_DASH} ", text, flags=re.M)
    text = re.sub(r"^\|(.+)\|[ \t]*$", lambda m: "\t".join(c.strip() for c in m[1].split("|")), text, flags=re.M)
    text = _LINK.sub(lambda m: m[1], text)
    return _STRIKE.sub(lambda m: m[1], _unstressed(text))


def render(text: str, kinds: list[str], drop: set[int] = frozenset()) -> tuple[str, int]:
    """Plain text without the subtrees in ``drop``, and how many were left out.

    Headings begin with as many ``#`` as their level and a blank, items with a dash or their number, code
    blocks stand between lines of three backticks, cells are apart by tabs, formulas stay as they are.
    """
    if not kinds:
        return text, 0
    kept: list[str] = []
    done, gone = _write(tree(re.sub("[\x00-\x03]", "", text), kinds), drop, kept)
    if LATEX in kinds:
        done = _latex(done, kept)
    if WIKI in kinds:
        done = _wiki(done, kept, MARKDOWN in kinds)
    if MARKDOWN in kinds:
        done = _markdown(done, kept)
    done = re.sub(r"[ \t\xa0]+\n", "\n", done.replace("\u200b", ""))
    done = re.sub(f"\n{{2,}}(?={_DASH} |\\d+\\. )", lambda m: m[0] if _opens_list(done, m.start()) else "\n", done)
    done = re.sub(r"\n{3,}", "\n\n", done).strip("\n\t ")
    for sign, written in _SIGNS.items():
        done = done.replace(sign, written)
    return _given_back(done, kept), gone


_ITEM = re.compile(f"{_DASH} |\\d+\\. ")


def _opens_list(text: str, end: int) -> bool:
    """Whether the line that ends there is no item itself."""
    return not _ITEM.match(text, text.rfind("\n", 0, end) + 1)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page, subtrees of each text that holds markup."""
    for batch in batches:
        hosts, pages, hashes = [], [], []
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k := kinds_of(text):
                hosts.append(host)
                pages.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
                hashes.append(sorted(set(hashed(tree(text, k)))))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "page", "subtrees"])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = [kinds_of(t) for t in batch.column(2).to_pylist()]
        pairs = [render(t, k, set(d or ())) for t, k, d in zip(batch.column(2).to_pylist(), kinds, batch.column(3).to_pylist())]
        texts, counts = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["id", "host", "markup", "clean_text", "removed"])


#: Template subtrees of all hosts that may be broadcast (a name and 8 bytes each); with more, texts meet their host's in a salted shuffle.
BROADCAST_TEMPLATES = 1_000_000
SALTS = 64


def templates(rows: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, gone: the subtrees that stand on so many different pages of a host, and on such a share of those with markup."""
    read = cut(rows.select("host", "text").mapInArrow(_subtrees, "host string, page bigint, subtrees array<bigint>").distinct())  # hashes, no texts
    of_host = read.groupBy("host").agg(F.count_distinct("page").alias("n_pages"))
    counts = read.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= min_pages).join(of_host, "host").where(F.col("n") >= F.col("n_pages") * min_share)
    return found.groupBy("host").agg(F.collect_set("subtree").alias("gone"))  # a page's subtrees / min_share at most


def clean(df: DataFrame, key: str, text: str, host: str, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, repeats: bool = False) -> DataFrame:
    """id, host, markup (sorted kinds), clean_text, removed (template subtrees left out) of each row.

    Null texts are empty; a text without markup stays as it is.  A null host is a host of its own.
    Null keys are kept; rows delivered twice (same key, host and text) count once.  Pages of one host with equal
    text count as one page for the template count, so reposts make no template.  With ``repeats``
    rows delivered twice stay, for callers that take distinct results of their own.
    """
    c = lambda name: F.col(f"`{name}`").cast("string")
    rows = df.select(c(key).alias("id"), F.coalesce(c(host), F.lit("")).alias("host"), F.coalesce(c(text), F.lit("")).alias("text"))
    rows = rows if repeats else once(rows)
    per_host = cut(templates(rows, min_pages, min_share))
    size = per_host.agg(F.sum(F.size("gone"))).first()[0] or 0
    if size <= BROADCAST_TEMPLATES:
        hit = rows.join(F.broadcast(per_host), "host", "left")
    else:
        salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = rows.withColumn("salt", F.pmod(F.xxhash64("id", "text"), SALTS).cast("int")).join(salted, ["host", "salt"], "left")
    return hit.select("id", "host", "text", "gone").mapInArrow(_rendered, "id string, host string, markup array<string>, clean_text string, removed int")
