"""Features of leaves: the element they are, the elements around them, neighbouring shapes, their text, and the page's marks."""

from __future__ import annotations

import re

from marlspike.llm.markup.leaves import MARKS, Leaf, marks

LANGUAGES = ("html", "markdown", "wiki", "latex")
#: What a leaf can be, as kind:language.  Inline marks are leaves too; those that mark nothing are text.
LABELS = [
    "text",
    *(f"{kind}:{language}" for kind in ("heading", "item", "code", "other", "mark") for language in LANGUAGES),
    "formula:wiki",
    "formula:latex",
    "redirect:wiki",
]

#: Shapes that only one language has; on a page they are evidence for what may be of several.
_OWN = {
    "pre": "html", "h": "html", "li": "html", "table": "html", "mark tag": "html", "mark entity": "html",
    "highlight": "wiki", "math": "wiki", "equals": "wiki", "wikitable": "wiki", "template": "wiki", "note": "wiki", "category": "wiki",
    "mark double bracket": "wiki", "mark bracket address": "wiki", "mark quotes": "wiki", "mark own tag": "wiki", "mark double brace": "wiki",
    "fence": "markdown", "underlined": "markdown", "box": "markdown", "dash": "markdown", "plus": "markdown", "number": "markdown",
    "mark bracket paren": "markdown", "mark two brackets": "markdown", "mark stars": "markdown", "mark underscores": "markdown", "mark tildes": "markdown", "mark backtick": "markdown", "mark bar rule": "markdown",
    "verbatim": "latex", "section": "latex", "bibitem": "latex", "equation": "latex", "paren": "latex", "bracket": "latex", "tabular": "latex", "environment": "latex",
    "mark command": "latex", "mark group": "latex", "mark percent": "latex",
}
_AMBIGUOUS = ("hash", "hashes", "star", "star blank", "stars", "inset star")
#: Shapes whose marks tell the page's languages to ambiguous ones; those whose marks are in their body; those without any.
_TELLING = (*_AMBIGUOUS[:-1], "line", "li", "bibitem", "underlined")
_BODIED = ("h", "li", "section", "bibitem", "pre")
_UNMARKED = ("pre", "highlight", "fence", "verbatim", "math", "equation", "dollars", "bracket", "paren", "hidden")


def with_marks(page: str, found: list[Leaf]) -> tuple[list[Leaf], list[int]]:
    """The leaves followed by their inline marks, and the place of the leaf that each of these stands in."""
    inner, parents = [], []
    for i, leaf in enumerate(found):
        if leaf.shape in _UNMARKED:
            continue
        for shape in marks(leaf.body if leaf.shape in _BODIED else page[leaf.start : leaf.end]):
            inner.append(Leaf(leaf.start, leaf.end, shape, "", leaf.shape, leaf.path))
            parents.append(i)
    return [*found, *inner], parents


def page_features(page: str, found: list[Leaf], parents: list[int]) -> list[list[str]]:
    """One list of features a leaf; ``found`` ends with the inline marks of its first leaves (``with_marks``)."""
    blocks = found[: len(found) - len(parents)]
    own: list[set[str]] = [set() for _ in blocks]
    for mark, parent in zip(found[len(blocks) :], parents, strict=True):
        own[parent].add(_OWN[mark.shape])
    sure = {_OWN[leaf.shape] for leaf in blocks if leaf.shape in _OWN}
    for leaf, languages in zip(blocks, own, strict=True):
        if leaf.shape in _TELLING:
            sure |= languages
    evidence = "".join(x[0] for x in sorted(sure)) or "none"
    features = []
    held: set[int] = set()
    for i, leaf in enumerate(blocks):
        before, after = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
        shape, body = leaf.shape, leaf.body.strip()
        parent = leaf.path[-1] if leaf.path else "page"
        row = [f"shape={shape}", f"shape={shape} around={leaf.around or 'page'}", f"shape={shape} parent={parent}"]
        row += [f"shape={shape} under={name}" for name in sorted(set(leaf.path))]
        row += [f"shape={shape} page={name}" for name in sorted(sure)]
        if shape in _AMBIGUOUS:
            row += [f"shape={shape} evidence={evidence}"]
            tight_before = before is not None and page[before.end : leaf.start].count("\n") <= 1
            tight_after = after is not None and page[leaf.end : after.start].count("\n") <= 1
            row += [f"shape={shape} before={before.shape if before and tight_before else '-'}", f"shape={shape} after={after.shape if after and tight_after else '-'}"]
            row += [f"shape={shape} own={name}" for name in sorted(own[i])]
        if shape == "dollar":
            inner = leaf.body
            row += [
                f"dollar tight={not inner[:1].isspace() and not inner[-1:].isspace()}",
                f"dollar digit follows={page[leaf.end : leaf.end + 1].isdigit()}",
                f"dollar marks={bool(re.search(r'[\\^_=+<>{}]', inner))}",
                f"dollar words={min(3, len(re.findall(r'[A-Za-z]{3,}', re.sub(r'\\[a-zA-Z]+', '', inner))))}",
            ]
        if shape == "line":
            bare = _BARE.sub("", body).strip()
            row += [f"line stop={body[-1:] in '.!?:'}", f"line words={min(4, len(body.split()) // 4)}", f"line bare={not bare}"]
            if leaf.owner >= 0:
                row += [f"line in item, first={leaf.owner not in held} bare={not bare}"]
        if leaf.owner >= 0 and body:
            held.add(leaf.owner)
        features.append(row)
    for mark, at in zip(found[len(blocks) :], parents, strict=True):
        features.append([f"shape={mark.shape}", f"shape={mark.shape} around={mark.around}", f"shape={mark.shape} parent={blocks[at].path[-1] if blocks[at].path else 'page'}"])
    return features


_BARE = re.compile(r"</?[a-zA-Z][^<>]*>")

__all__ = ["LABELS", "LANGUAGES", "MARKS", "page_features", "with_marks"]
