"""The leaf blocks of a page: its elements, and the lines of what stands outside them, in a tree of elements.

A leaf has a span in the page, a shape (how it is written), the body inside its marks, the path of elements around it and
the number of the list item it stands in.  Shapes only say what a leaf looks like; what it is, the random field decides.
Every scan is linear in the page: an end mark that isn't found is not looked for again, and braces are matched once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple


class Leaf(NamedTuple):
    start: int
    end: int
    shape: str
    body: str
    around: str = ""
    path: tuple[str, ...] = ()
    owner: int = -1


#: Where an element may start; what it is, ``_element`` finds out.
_OPENERS = re.compile(r"\$|<|\\|`{3}|~{3}|\{[{|]|^[ \t]*%", re.M)
_TAG = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)\b")
_FENCE = re.compile(r"(`{3,}|~{3,})[^\n`]*\n")
_BEGIN = re.compile(r"\\begin\{([a-zA-Z]+\*?)\}")
_SECTION = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{", re.I)
_LABEL = re.compile(r"\\label\{[^{}]*\}", re.I)
_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?", re.I)
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", re.I)
_REMARK = re.compile(r"[ \t]*%[^\n]*", re.M)
_DOLLARS = re.compile(r"(?<!\\)\$\$([^$]+)\$\$")
_DOLLAR = re.compile(r"(?<![\\$])\$([^$\n]+)(?<!\\)\$(?!\$)")
_LI_END = re.compile(r"</?(?:li|ul|ol|h[1-6]|p|div|table|pre)\b|\n[ \t]*\n", re.I)
_ITEM_END = re.compile(r"\\item\b|\\(?:begin|end)\{|\n[ \t]*\n", re.I)
_TABLE_END = re.compile(r"^\|\}", re.M)
_VERBATIM = ("verbatim", "verbatim*", "lstlisting", "minted")
_EQUATIONS = tuple(n + star for n in ("equation", "align", "gather", "displaymath", "eqnarray", "multline", "math") for star in ("", "*"))
_TABULAR = ("tabular", "tabular*", "table", "table*", "array")
#: Lines that are items or headings by their first mark; inline elements don't cut them.
_MARKED = re.compile(r"[ \t]*(?:#|\*|={2,6}|-[ \t]|\+[ \t]|\d+[.)][ \t])")


class _Page:
    """A page with the ends of its elements, each kind of which is found missing once at most."""

    def __init__(self, text: str):
        self.text, self._missing = text, {}
        self._braces: dict[str, dict[int, int]] = {}

    def find(self, pattern: str | re.Pattern, at: int) -> tuple[int, int] | None:
        """The first place of an end mark from ``at`` on; a text as pattern is sought as it is."""
        if self._missing.get(pattern, len(self.text) + 1) <= at:
            return None
        if isinstance(pattern, str):
            found = self.text.find(pattern, at)
            span = None if found < 0 else (found, found + len(pattern))
        else:
            match = pattern.search(self.text, at)
            span = match and match.span()
        if span is None:
            self._missing[pattern] = min(at, self._missing.get(pattern, at))
        return span

    def closing(self, at: int, double: bool) -> int | None:
        """The place of the brace, or pair of braces, that closes the one at ``at``."""
        key = "{{" if double else "{"
        if key not in self._braces:
            self._braces[key] = closed = {}
            opened: list[int] = []
            for match in re.finditer(r"\{\{|\}\}" if double else r"\\[{}]|[{}]", self.text):
                if match[0] == key:
                    opened.append(match.start())
                elif match[0] == key.replace("{", "}") and opened:
                    closed[opened.pop()] = match.start()
        return self._braces[key].get(at)


def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def _element(page: _Page, at: int) -> tuple[str, int, str | None] | None:
    """(shape, end, body) of the element that starts at ``at``; a body of None is the whole element."""
    text, size = page.text, len(page.text)
    first = text[at]
    if first == "<":
        return _tagged(page, at)
    if first == "$":
        for shape, pattern in (("dollars", _DOLLARS), ("dollar", _DOLLAR)):
            if match := pattern.match(text, at):
                return shape, match.end(), match[1]
        return None
    if first in "`~":
        match, line = _FENCE.match(text, at), text.rfind("\n", 0, at) + 1
        if not match or at - line > 3 or text[line:at].strip(" "):
            return None
        span = page.find(re.compile(rf"^[ ]{{0,3}}{re.escape(match[1])}[`~]*[ \t]*$", re.M), match.end())
        return "fence", span[1] if span else size, text[match.end() : span[0] if span else size]
    if first == "{":
        if text[at + 1] == "|":
            span = (at == 0 or text[at - 1] == "\n") and page.find(_TABLE_END, at)
            return ("wikitable", span[1], None) if span else None
        end = page.closing(at, double=True)
        return None if end is None else ("template", end + 2, None)
    if first != "\\":
        match = _REMARK.match(text, at)
        return match and ("remark", match.end(), None)
    for opening, ending, shape in (("\\[", "\\]", "bracket"), ("\\(", "\\)", "paren")):
        if text.startswith(opening, at):
            span = page.find(ending, at + 2)
            return span and (shape, span[1], text[at + 2 : span[0]])
    if match := _BEGIN.match(text, at):
        name, kind = match[1], match[1].lower()
        span = page.find(f"\\end{{{name}}}", match.end())
        if kind in _VERBATIM:
            options = re.compile(r"\[[^\]\n]*\]").match(text, match.end()) or match
            return "verbatim", span[1] if span else size, text[options.end() : span[0] if span else size]
        if kind in _EQUATIONS and span:
            return "equation", span[1], text[match.end() : span[0]]
        if kind in _TABULAR and span:
            return "tabular", span[1], None
    if match := _SECTION.match(text, at):
        end = page.closing(match.end() - 1, double=False)
        if end is not None:
            label = _LABEL.match(text, end + 1)
            return "section", label.end() if label else end + 1, text[match.end() : end]
    if match := _ITEM.match(text, at):
        span = page.find(_ITEM_END, match.end())
        end = span[0] if span else size
        return "bibitem", end, text[match.end() : end]
    match = _ENVIRONMENT.match(text, at)
    return match and ("environment", match.end(), None)


def _tagged(page: _Page, at: int) -> tuple[str, int, str | None] | None:
    text, size = page.text, len(page.text)
    if text.startswith("<!--", at):
        span = page.find("-->", at)
        return "comment", span[1] if span else size, None
    match = _TAG.match(text, at)
    name = match[1].lower() if match else ""
    if name not in _TAGS and not re.fullmatch("h[1-6]", name):
        return None
    opened = page.find(">", match.end())
    if not opened:
        return None
    inside = opened[1]
    if name == "li":
        span = page.find(_LI_END, inside)
        return "li", span[0] if span else size, text[inside : span[0] if span else size]
    if name == "ref" and text[inside - 2] == "/":
        return "note", inside, None
    shape, needed = _TAGS.get(name, ("h", True))
    span = page.find(_ENDS.setdefault(name, _end_tag(name)), inside)
    if not span and needed:
        return None
    body = None if shape in ("hidden", "table", "note") else text[inside : span[0] if span else size]
    return shape, span[1] if span else size, body


#: Shapes of elements by their tag, and whether they must have an end tag.
_TAGS = {"script": ("hidden", False), "style": ("hidden", False), "pre": ("pre", False), "syntaxhighlight": ("highlight", False), "source": ("highlight", False), "math": ("math", True), "table": ("table", False), "ref": ("note", True), "li": ("li", False)}
_ENDS: dict[str, re.Pattern] = {}


_LINES = [
    ("redirect", re.compile(r"\s*#redirect\b(?P<b>.*)", re.I)),
    ("equals", re.compile(r"(?P<m>={1,6})(?P<b>[^=\n](?:.*[^=])?)(?P=m)\s*$")),
    ("hashes", re.compile(r"#{2,6}[ \t]+(?P<b>.*?)(?:[ \t]+#+)?[ \t]*$")),
    ("hash", re.compile(r"#[:*#]*[ \t]*(?P<b>.*?)[ \t]*$")),
    ("box", re.compile(r"[ \t]*[-+*][ \t]+\[[ xX]\][ \t]+(?P<b>.*)$")),
    ("rule", re.compile(r"(?P<b>(?:-[ \t]*){3,}|(?:=){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")),
    ("dash", re.compile(r"[ \t]*-[ \t]+(?P<b>.*)$")),
    ("plus", re.compile(r"[ \t]*\+[ \t]+(?P<b>.*)$")),
    ("number", re.compile(r"[ \t]*\d+[.)][ \t]+(?P<b>.*)$")),
    ("inset star", re.compile(r"[ \t]+\*[ \t]+(?P<b>.*)$")),
    ("stars", re.compile(r"\*(?=\*+[^*]*$)[*#:]+[ \t]*(?P<b>.*)$")),
    ("star blank", re.compile(r"\*[ \t]+(?P<b>.*)$")),
    ("star", re.compile(r"\*(?!\*)(?P<b>[^*].*|'.*)$")),
    ("bar", re.compile(r"[ \t]*\|(?P<b>.*)$")),
    ("category", re.compile(r"\[\[(?:category|file|image):(?P<b>[^\]]*)\]\]\s*$", re.I)),
]
_UNDERLINE = re.compile(r"[ ]{0,3}(?:=+|-+)[ \t]*$")


def _lines(text: str, offset: int, around: str) -> list[Leaf]:
    """Leaves of text without elements: a line each, or a line with the underline below it."""
    found: list[Leaf] = []
    at = offset
    rows = text.split("\n")
    i = 0
    while i < len(rows):
        row = rows[i]
        end = at + len(row)
        if row.strip():
            shape, body = "line", row
            for name, pattern in _LINES:
                match = pattern.match(row)
                if match:
                    shape, body = name, match["b"]
                    break
            below = rows[i + 1] if i + 1 < len(rows) else ""
            if shape == "line" and len(below.strip()) >= 3 and _UNDERLINE.match(below):
                shape, end = "underlined", end + 1 + len(below)
                i += 1
            found.append(Leaf(at, end, shape, body, around))
        at = end + 1
        i += 1
    return found


def _elements(page: _Page) -> Iterator[tuple[int, int, str, str | None]]:
    """(start, end, shape, body) of the elements that cut their lines, in order."""
    text, at = page.text, 0
    while opener := _OPENERS.search(text, at):
        found = _element(page, opener.start())
        if not found:
            at = opener.end() if opener.end() > opener.start() else opener.start() + 1
            continue
        shape, end, body = found
        at = end
        if shape in ("note", "comment", "template") and "\n" not in text[opener.start() : end] and not _alone(text, opener.start(), end):
            continue  # stays inside its line, cleaned with it
        if shape in ("dollar", "math", "paren") and _MARKED.match(text, text.rfind("\n", 0, opener.start()) + 1):
            continue  # so does a formula in an item or heading
        yield opener.start(), end, shape, body


def leaves(page: str) -> list[Leaf]:
    """All leaves of a page in order; inline elements cut the line they stand in."""
    found: list[Leaf] = []
    done = 0
    for start, end, shape, body in _elements(_Page(page)):
        if start > done:
            found.extend(_lines(page[done:start], done, ""))
        found.append(Leaf(start, end, shape, page[start:end] if body is None else body))
        done = end
    if done < len(page):
        found.extend(_lines(page[done:], done, ""))
    return _nested(_in_tree(page, found))


def _alone(page: str, start: int, end: int) -> bool:
    before, after = page.rfind("\n", 0, start) + 1, page.find("\n", end)
    return not page[before:start].strip() and not page[end : len(page) if after < 0 else after].strip()


_NODE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)>|\\(begin|end)\{([a-zA-Z]+)\*?\}|\n[ \t]*\n")
#: Elements that hold blocks; of others only text is inside.
_CONTAINERS = {"div", "section", "article", "main", "blockquote", "ul", "ol", "li", "dl", "dt", "dd", "p", "table", "tr", "td", "th", "tbody", "thead", "center", "body", "html", "nav", "aside"}
_LISTS, _OUTSIDE = ("ul", "ol"), ("pre", "highlight", "fence", "verbatim", "comment", "hidden", "math", "equation", "dollars", "dollar", "bracket", "paren")


def _in_tree(page: str, found: list[Leaf]) -> list[Leaf]:
    """The leaves with the elements around them: one pass over the tags outside code and formulas, with a stack of open ones.

    An end tag closes what is open inside it; a new item closes the one before it, and a blank line items without an end.
    """
    if "<" not in page and "\\begin" not in page:
        return found
    opaque = [(leaf.start, leaf.end) for leaf in found if leaf.shape in _OUTSIDE]
    ends = [end for _, end in opaque]
    stack: list[tuple[str, int]] = []
    places, states = [0], [()]
    for number, match in enumerate(_NODE.finditer(page)):
        inside = bisect_right(ends, match.start())
        if inside < len(opaque) and opaque[inside][0] <= match.start():
            continue
        name = (match[2] or match[5] or "").lower()
        if match[5] is None and name and name not in _CONTAINERS:
            continue
        if not name:
            while stack and stack[-1][0] in ("li", "p"):
                stack.pop()
        elif match[1] or match[4] == "end":
            at = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 200), -1) if stack[i][0] == name), None)
            if at is not None:
                del stack[at:]
        elif not match[3]:
            if name == "li":
                while stack and stack[-1][0] not in _LISTS and any(x == "li" for x, _ in stack[-8:]):
                    stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((name, number))
        places.append(match.end())
        states.append(tuple(stack[-8:]))
    placed = []
    for leaf in found:
        state = states[bisect_right(places, leaf.start) - 1]
        inner = states[bisect_right(places, leaf.start + page[leaf.start : leaf.end].find(">") + 1) - 1] if leaf.shape == "li" else state
        owner = next((n for name, n in reversed(inner) if name == "li"), -1)
        placed.append(leaf._replace(path=tuple(name for name, _ in state), owner=owner))
    return placed


_HOLDERS = ("li", "bibitem", "h", "section", "equals", "hashes", "hash", "box", "dash", "plus", "number", "inset star", "stars", "star blank", "star", "underlined")


def _nested(found: list[Leaf]) -> list[Leaf]:
    """Adds the formulas inside list items and headings, which those leaves hold in their own body."""
    whole = []
    for leaf in found:
        whole.append(leaf)
        if leaf.shape in _HOLDERS and ("$" in leaf.body or "\\(" in leaf.body or "<math" in leaf.body):
            page, at = _Page(leaf.body), 0
            while opener := _OPENERS.search(leaf.body, at):
                element = _element(page, opener.start()) if leaf.body[opener.start()] in "$<\\" else None
                at = max(opener.end(), opener.start() + 1)
                if element and element[0] in ("math", "paren", "dollar"):
                    whole.append(Leaf(leaf.start + 1, leaf.start + 1, element[0], element[2] or "", leaf.shape, leaf.path))
                    at = element[1]
    return whole


#: Inline marks by shape; which language a mark is of, if any, the field decides.
MARKS = {
    "mark tag": re.compile(r"</?(?!(?:ref|math|nowiki|syntaxhighlight|source|gallery|references)\b)[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>|<!--"),
    "mark entity": re.compile(r"&(?:nbsp|amp|lt|gt|quot|apos|mdash|ndash|hellip|copy|eacute|#\d+|#x[0-9a-fA-F]+);"),
    "mark double bracket": re.compile(r"\[\[[^\[\]\n]+\]\]"),
    "mark bracket address": re.compile(r"\[https?://[^\s\]]+ [^\]\n]+\]"),
    "mark quotes": re.compile(r"'''?[^'\n]+'''?"),
    "mark own tag": re.compile(r"<(?:ref|math|nowiki|syntaxhighlight|source|gallery|references)\b"),
    "mark double brace": re.compile(r"\{\{[^{}]+\}\}|^\{\|", re.M),
    "mark bracket paren": re.compile(r"\[[^\[\]\n]*\]\([^)\s]+\)"),
    "mark two brackets": re.compile(r"\[[^\[\]\n]+\]\[[^\[\]\n]+\]"),
    "mark stars": re.compile(r"\*\*[^*\n]+\*\*"),
    "mark underscores": re.compile(r"(?<!\w)__\w[^_\n]*__(?!\w)"),
    "mark tildes": re.compile(r"~~[^~\s][^~\n]*~~"),
    "mark backtick": re.compile(r"(?<!`)`[^`\n]+`(?!`)"),
    "mark bar rule": re.compile(r"^\|[ \t]*:?-{3,}", re.M),
    "mark command": re.compile(r"\\(?:emph|text(?:bf|it|tt|sc|rm|sf)|cite[pt]?|footnote|label|ref|(?:sub){0,2}section|chapter|begin|end|item|url|href)\*?\s*[\[{]|\\item\b|\\[(\[]"),
    "mark group": re.compile(r"\{\\(?:em|bf|it|tt|sc)\b"),
    "mark percent": re.compile(r"^[ \t]*%[ \t]", re.M),
}
#: One of these characters is in every mark.
_ANY = re.compile(r"[<&\['{*_~`|\\%]")


def marks(text: str) -> list[str]:
    """The shapes of the inline marks in a text, each once."""
    return [shape for shape, pattern in MARKS.items() if pattern.search(text)] if _ANY.search(text) else []
