"""Text without markup: of headings, items and running text."""

from __future__ import annotations

import html
import re

_TEX_ESCAPE = re.compile(r"\\([&%$#_{}])")
_MARKDOWN_ESCAPE = re.compile(r"\\([\\`*_{}\[\]()#+\-.!~|>])")


def squeezed(text: str) -> str:
    """Runs of whitespace as one blank, none at the ends."""
    return " ".join(text.split())


def without_tags(text: str) -> str:
    text = _between(text, re.compile("<!--"), re.compile("-->"))
    text = re.sub(r"<br\s*/?>", " ", text, flags=re.I)
    return re.sub(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)?/?>", "", text)


def of_html(text: str) -> str:
    return html.unescape(without_tags(text))


def _without_templates(text: str) -> str:
    """Templates, however deep, are taken out, but for the text of {{nowrap|...}}; unclosed ones stay as they are."""
    opened: list[list[str]] = [[]]
    for part in re.split(r"(\{\{|\}\})", text):
        if part == "{{":
            opened.append([])
        elif part == "}}" and len(opened) > 1:
            inside = "".join(opened.pop())
            opened[-1].append(inside[7:] if inside[:7].lower() == "nowrap|" else "")
        else:
            opened[-1].append(part)
    return "{{".join("".join(parts) for parts in opened)


def of_wiki(text: str) -> str:
    text = re.sub(r"<ref\b[^<>]*/>", "", text, flags=re.I)
    text = _between(text, re.compile(r"<ref\b[^<>]*>", re.I), re.compile(r"</ref\s*>", re.I))
    if "{{" in text:
        text = _without_templates(text)
    text = re.sub(r"\[\[(?:file|image|category):[^\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\[\]]+\s+([^\[\]]*)\]", r"\1", text)
    text = re.sub(r"'''''(.+?)'''''|'''(.+?)'''|''(.+?)''", lambda m: m[1] or m[2] or m[3], text)
    return html.unescape(without_tags(text))


def _between(text: str, start: re.Pattern, end: re.Pattern) -> str:
    """Without what stands between marks; a start that has no end stays."""
    out, at = [], 0
    while opened := start.search(text, at):
        closed = end.search(text, opened.end())
        if not closed:
            break
        out.append(text[at : opened.start()])
        at = closed.end()
    return "".join(out) + text[at:]


def of_markdown(text: str) -> str:
    kept: list[str] = []

    def hide(match: re.Match) -> str:
        kept.append(match[1])
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"(?<!`)`+([^`]+)`+(?!`)", hide, text)
    text = _MARKDOWN_ESCAPE.sub(hide, text)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"!?\[([^\]]+)\]\[[^\]]*\]", r"\1", text)
    text = re.sub(r"\*{1,3}(?=\S)([^*]+?)(?<=\S)\*{1,3}", r"\1", text)
    text = re.sub(r"(?<!\w)_{1,3}(?=\S)([^_]+?)(?<=\S)_{1,3}(?!\w)", r"\1", text)
    text = re.sub(r"~~(?=\S)(.+?)~~", r"\1", text)
    text = html.unescape(without_tags(text))
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)


_TEX = re.compile(
    r"(?P<kept>\\[\\{}])"
    r"|(?P<drop>~?\\(?:cite[pt]?|footnote|label|ref|index)\*?(?:\[[^\[\]]*\])?\{)"
    r"|(?P<href>\\href\{)"
    r"|(?P<open>\\(?!(?:begin|end)\b)[a-zA-Z]+\*?\{|\{\\(?:em|bf|it|tt|sc|rm|sf|bfseries|itshape|ttfamily|scshape)\b\s*)"
    r"|(?P<plain>\{)|(?P<close>\})"
)


def _without_commands(text: str) -> str:
    """Commands, however deep, give way to their argument; notes, citations and labels go with it; other braces stay."""
    opened: list[tuple[str, str, list[str]]] = [("", "", [])]
    at, after_address = 0, -1
    for match in _TEX.finditer(text):
        opened[-1][2].append(text[at : match.start()])
        at, kind = match.end(), match.lastgroup
        if kind == "kept":
            opened[-1][2].append(match[0])
        elif kind != "close":
            shown = kind == "plain" and match.start() == after_address  # the text of a link
            opened.append(("open" if shown else kind, match[0], []))
        elif len(opened) == 1:
            opened[-1][2].append("}")
        else:
            kind, mark, parts = opened.pop()
            inside = "".join(parts)
            after_address = at if kind == "href" else -1
            opened[-1][2].append({"open": inside, "plain": f"{{{inside}}}"}.get(kind, ""))
    whole = "".join(mark + "".join(parts) for _, mark, parts in opened)
    return whole + text[at:]


def of_latex(text: str) -> str:
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    if "\\" in text:
        text = _without_commands(text)
    text = re.sub(r"\\\\(?:\[[^\]\n]*\])?", " ", text)
    text = _TEX_ESCAPE.sub(r"\1", text.replace("~", " "))
    return text.replace("``", '"').replace("''", '"')


CLEANERS = {"html": of_html, "wiki": of_wiki, "markdown": of_markdown, "latex": of_latex}


def of_running(text: str, languages: set[str]) -> str:
    """Running text, rid of the marks of the languages that the page uses."""
    for name in ("latex", "wiki", "markdown", "html"):
        if name in languages:
            text = CLEANERS[name](text)
    return text


def table_rows(shape: str, text: str) -> list[str]:
    """The rows of a table, or of a line of one, with cells between bars; no rows for what isn't one."""
    if shape == "table":
        rows = [[of_html(c) for c in re.split(r"<t[dh]\b[^>]*>", r, flags=re.I)[1:]] for r in re.split(r"<tr\b[^>]*>", text, flags=re.I)]
    elif shape == "wikitable":
        lines = [x.strip() for x in text.split("\n")]
        rows = [[of_wiki(c) for c in re.split(r"\|\||!!", x.lstrip("|!"))] for x in lines if x[:1] in ("|", "!") and x[:2] not in ("|-", "|}", "|+")]
    elif shape == "tabular":
        inner = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?|\\hline", "", text)
        rows = [[of_latex(c) for c in re.split(r"(?<!\\)&", r)] for r in re.split(r"\\\\", inner)]
    elif shape == "bar" and not re.fullmatch(r"[\s|:\-]+", text):
        rows = [[of_markdown(c) for c in text.strip().strip("|").split("|")]]
    else:
        rows = []
    return [" | ".join(cells) for row in rows if any(cells := [squeezed(c) for c in row])]
