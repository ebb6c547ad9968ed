"""Labelled pages to train on, written by rule from random words, and the model trained on them.

The model's weights are kept beside this file; ``python -m marlspike.llm.markup.training`` makes them anew.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache
from pathlib import Path

from marlspike.llm.markup.crf import ChainField
from marlspike.llm.markup.features import _OWN, LABELS, page_features, with_marks
from marlspike.llm.markup.leaves import leaves

#: Pages the model is trained on, and the seed they are drawn with.
TRAINING_PAGES = 360
SEED = 20
WEIGHTS = Path(__file__).with_name("weights.json")

_SYLLABLES = ["ba", "do", "fi", "gu", "he", "ka", "lo", "mi", "nu", "pe", "ra", "so", "ti", "vu", "ze"]
_FORMULAS = ["x^2 + y^2 = r", "\\frac{a}{b} + 1", "e_1 < e_2", "m = n - 4", "\\sqrt{k}", "f(t) = 2t", "p(x \\mid y)"]
_CODE = ["if a < b and c:", "# read the file", "* a note", "== part ==", "    return q[0]", "let v = &w;", "- item", "SELECT a FROM b", "print('x', y)"]


class Writer:
    """Writes pages and keeps the span and label of every block; ``text@language`` is text with marks of a language."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def word(self) -> str:
        return "".join(self.draw.choices(_SYLLABLES, k=self.draw.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.draw.randint(least, most)))

    def marked(self, language: str, text: str) -> str:
        """Text in which one word may have an inline mark."""
        if self.draw.random() < 0.5:
            return text
        words = text.split(" ")
        i = self.draw.randrange(len(words))
        forms = {
            "html": ["<i>{}</i>", "<b>{}</b>", '<a href="http://a.example/?b=1&amp;c=2">{}</a>', "{}&nbsp;", "{}<br/>", '<span class="k">{}</span>', "{} &amp;"],
            "wiki": ["[[{}]]", "''{}''", "'''{}'''", "[[Other|{}]]", "[http://a.example {}]", "{}<ref>Page 3</ref>", "{{{{nowrap|{}}}}}"],
            "markdown": ["**{}**", "`{}`", "[{}](http://a.example)", "~~{}~~", "__{}__", "[{}][r1]", "![{}](a.png)"],
            "latex": ["\\emph{{{}}}", "\\textbf{{{}}}", "{}\\footnote{{Seen.}}", "{{\\em {}}}", "{}~\\cite{{k1}}"],
        }
        words[i] = self.draw.choice(forms[language]).format(words[i])
        return " ".join(words)

    def sentence(self) -> str:
        plain = [
            "{} cost $12 and {} $30 there.", "Note [3] on {} and {}.", "They had 4 * 3 * 2 of {} {}.", "The {} R&D was {}.",
            "The set {{x, y}} of {} {}.", "The path C:\\data\\{} of {}.", "{} | {} | age.", "He wrote (1) {}, (2) {}.", "{} < 5 and {} > 7.",
        ]
        if self.draw.random() < 0.2:
            return self.draw.choice(plain).format(self.word(), self.word())
        return self.words(5, 14).capitalize() + "."

    def paragraph(self, language: str | None) -> list[tuple[str, str]]:
        rows = []
        for _ in range(self.draw.randint(1, 3)):
            plain = self.sentence()
            text = self.marked(language, plain) if language else plain
            rows.append((text, "text" if text == plain else f"text@{language}"))
            if language in ("latex", "wiki") and self.draw.random() < 0.25:
                body = self.draw.choice(_FORMULAS)
                form = self.draw.choice(["$%s$", "\\(%s\\)"]) if language == "latex" else "<math>%s</math>"
                rows += [(form % body, f"formula:{language}"), (self.words(3, 6) + ".", "text")]
        joined = [(text + " ", label) for text, label in rows]
        if language == "html" and self.draw.random() < 0.7:
            joined = [("<p>", "text@html"), *joined, ("</p>", "text@html")]
        return joined

    def heading(self, language: str) -> list[tuple[str, str]]:
        text = self.marked(language, self.words(1, 5).capitalize()) if self.draw.random() < 0.3 else self.words(1, 5).capitalize()
        level = self.draw.randint(2, 4)
        form = {
            "html": [f"<h{level}>{text}</h{level}>", f'<H{level} class="t">\n  {text}\n</H{level}>'],
            "wiki": [f"{'=' * level} {text} {'=' * level}", f"{'=' * level}{text}{'=' * level}"],
            "markdown": [f"{'#' * self.draw.randint(1, level)} {text}", f"{text}\n{self.draw.choice('=-') * max(4, len(text))}", f"{'#' * level} {text} {'#' * level}"],
            "latex": [f"\\section{{{text}}}", f"\\subsection*{{{text}}}", f"\\section{{{text}}}\\label{{s:a}}"],
        }
        return [(self.draw.choice(form[language]), f"heading:{language}")]

    def items(self, language: str) -> list[tuple[str, str]]:
        texts = [self.marked(language, self.words(1, 6)) for _ in range(self.draw.randint(1, 6))]
        label = f"item:{language}"
        if language == "html":
            end, tag = self.draw.choice(["</li>", "</li>\n", "\n"]), self.draw.choice(["ul", "ul", "ol"])
            rows = []
            for t in texts:
                form = self.draw.random()
                if form < 0.12:  # the item's text is a block inside it
                    block = self.draw.choice(["p", "div", "blockquote"])
                    rows += [("<li>", label), (self.draw.choice(["", "\n  "]), label), (f"<{block}>{t}</{block}>", label), ("</li>\n", "text@html")]
                elif form < 0.24:  # a list inside it, and perhaps more text after that
                    more = self.words(2, 6) if self.draw.random() < 0.5 else ""
                    rows += [(f"<li>{t}", label), ("<ul>", "text@html"), (f"<li>{self.words(1, 4)}</li>", label), ("</ul>", "text@html"), (f"\n{more}", label if more else "text"), ("</li>\n", "text@html")]
                else:
                    rows.append((f"<li>{t}{end}", label))
            return [(f"<{tag}>", "text@html"), *rows, (f"</{tag}>", "text@html")]
        if language == "latex":
            return [("\\begin{itemize}\n", "other:latex"), *((f"  \\item {t}\n", label) for t in texts), ("\\end{itemize}", "other:latex")]
        mark = self.draw.choice(["* ", "*", "# ", "#", "** "] if language == "wiki" else ["- ", "+ ", "1. ", "- [ ] ", "- ", "+ ", "1. ", "* "])
        if language == "wiki" and self.draw.random() < 0.4:  # items within items
            return [((mark[0] if i and self.draw.random() < 0.3 else "") + mark + t + "\n", label) for i, t in enumerate(texts)]
        return [(("  " if language == "markdown" and i and self.draw.random() < 0.2 else "") + mark + t + "\n", label) for i, t in enumerate(texts)]

    def code(self, language: str) -> list[tuple[str, str]]:
        body = "\n".join(self.draw.choices(_CODE, k=self.draw.randint(1, 5)))
        form = {
            "html": ["<pre>\n%s\n</pre>", "<pre><code>%s</code></pre>"],
            "wiki": ['<syntaxhighlight lang="c">\n%s\n</syntaxhighlight>'],
            "markdown": ["```\n%s\n```", "~~~\n%s\n~~~", "```c\n%s\n```"],
            "latex": ["\\begin{verbatim}\n%s\n\\end{verbatim}", "\\begin{lstlisting}\n%s\n\\end{lstlisting}"],
        }
        return [(self.draw.choice(form[language]).replace("%s", body), f"code:{language}")]

    def formula(self, language: str) -> list[tuple[str, str]]:
        body = self.draw.choice(_FORMULAS)
        if language == "wiki":
            return [(": ", "text"), (f"<math>{body}</math>", "formula:wiki")]
        if language == "latex":
            form = self.draw.choice(["$$%s$$", "\\[ %s \\]", "\\begin{equation}\n  %s\n\\end{equation}"])
            return [(form % body, "formula:latex")]
        return self.paragraph(language)

    def other(self, language: str) -> list[tuple[str, str]]:
        form = {
            "html": ["<table><tr><td>a</td></tr></table>", "<style>.a { b: c }</style>", "<!-- c -->"],
            "wiki": ['{| class="wikitable"\n! A !! B\n|-\n| c || 4\n|}', "{{Infobox place\n| name = Hill\n}}", "[[Category:Places]]", "{{stub}}", "<ref>Seen there.</ref>"],
            "markdown": ["| A | B |\n|---|---|\n| c | 4 |"],
            "latex": ["\\begin{tabular}{ll}\na & 4 \\\\\n\\end{tabular}", "% a remark"],
        }
        return [(self.draw.choice(form[language]), f"other:{language}")]

    def page(self) -> tuple[str, list[tuple[int, int, str]]]:
        languages = ["html", "wiki", "markdown", "latex"]
        used = self.draw.sample(languages, self.draw.choice([0, 1, 1, 1, 2]))
        blocks: list[list[tuple[str, str]]] = []
        if used == ["wiki"] and self.draw.random() < 0.1:
            blocks = [[("#REDIRECT [[Other]]", "redirect:wiki")]]
        else:
            light = self.draw.random() < 0.25
            for _ in range(self.draw.randint(2, 8)):
                language = self.draw.choice(used) if used else None
                if language is None or light:
                    blocks.append(self.paragraph(language))
                    continue
                blocks.append(self.heading(language))
                blocks.append(self.paragraph(language))
                more = [self.items, self.items, self.code, self.formula, self.other]
                blocks += [f(language) for f in self.draw.sample(more, self.draw.randint(0, 3))]
                if language == "html" and self.draw.random() < 0.3:  # in another element
                    around = self.draw.choice(["div", "section", "blockquote"])
                    blocks[-1] = [(f"<{around}>\n", "text@html"), *blocks[-1], (f"\n</{around}>", "text@html")]
        text, spans = "", []
        for block in blocks:
            for part, label in block:
                spans.append((len(text), len(text) + len(part), label))
                text += part
            text = text.rstrip("\n") + "\n\n"
        return text, spans


def labelled_page(seed: int) -> tuple[list[list[str]], list[str]]:
    """Features and labels of the leaves of one page."""
    text, spans = Writer(seed).page()
    blocks = leaves(text)
    found, parents = with_marks(text, blocks)
    gold = []
    for leaf in blocks:
        at = next((i for i in range(leaf.start, leaf.end + 1) if i >= len(text) or not text[i].isspace()), leaf.start)
        label = next((label for start, end, label in spans if start <= at < end), "text").partition("@")[0]
        closing = label == "item:html" and leaf.shape == "line" and not re.sub(r"</?[a-z][^<>]*>", "", leaf.body).strip()
        gold.append("text" if closing else label)
    for mark, parent in zip(found[len(blocks) :], parents, strict=True):
        over = {re.split("[:@]", label)[-1] for start, end, label in spans if start < blocks[parent].end and blocks[parent].start < end}
        gold.append(f"mark:{_OWN[mark.shape]}" if _OWN[mark.shape] in over else "text")
    return page_features(text, found, parents), gold


def fitted(pages: int = TRAINING_PAGES, seed: int = SEED) -> ChainField:
    """The model trained on ``pages`` written pages."""
    whole = [labelled_page(seed * 1_000_000 + i) for i in range(pages)]
    return ChainField(LABELS).fit([x for x, _ in whole], [y for _, y in whole])


@lru_cache(maxsize=1)
def trained() -> ChainField:
    """The model with the weights that are kept, or trained if there are none."""
    return ChainField.from_dict(json.loads(WEIGHTS.read_text())) if WEIGHTS.exists() else fitted()


if __name__ == "__main__":
    WEIGHTS.write_text(json.dumps(fitted().to_dict(), separators=(",", ":")))
