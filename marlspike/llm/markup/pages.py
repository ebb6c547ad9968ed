"""What is on a page, and its clean text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.markup.clean import CLEANERS, of_html, of_running, squeezed, table_rows
from marlspike.llm.markup.crf import ChainField
from marlspike.llm.markup.features import page_features, with_marks
from marlspike.llm.markup.leaves import Leaf, leaves
from marlspike.llm.markup.training import trained

def _content(kind: str, language: str, leaf: Leaf) -> str:
    if kind == "code":
        return squeezed(of_html(leaf.body) if language == "html" else leaf.body)
    if kind == "formula":
        return squeezed(leaf.body)
    body = leaf.body
    if kind == "item" and language == "markdown":
        body = re.sub(r"^\[[ xX]\]\s+", "", body)
    if kind == "item" and leaf.shape == "hash":
        body = body.lstrip("#*: ")
    return squeezed(CLEANERS[language](body))


def _pieces(page: str, field: ChainField) -> tuple[list[tuple[str, str, Leaf]], set[str]]:
    """(kind, content, leaf) of each block leaf in order, and the languages that the labels of leaves and marks have."""
    blocks = leaves(page)
    found, parents = with_marks(page, blocks)
    labels = [label.partition(":") for label in field.decode(page_features(page, found, parents))]
    kinds = [kind for kind, _, _ in labels[: len(blocks)]]
    languages = {language for _, _, language in labels[: len(blocks)] if language}
    # what stands inside code and formulas marks nothing
    languages |= {language for (_, _, language), at in zip(labels[len(blocks) :], parents, strict=True) if language and kinds[at] not in ("code", "formula")}
    pieces = []
    for leaf, (kind, _, language) in zip(blocks, labels, strict=False):
        kind = "text" if kind == "mark" else kind
        pieces.append((kind, _content(kind, language, leaf) if kind in ("heading", "item", "code", "formula") else "", leaf))
    return pieces, languages


def elements(page: str | None, field: ChainField) -> list[tuple[str, str]]:
    """The distinct (kind, content) of a page: its languages (kind markup), headings, items, code blocks and formulas.

    The text of an item that has other blocks or items in it is that of its own leaves, one after the other.
    """
    if not page or not page.strip():
        return []
    pieces, languages = _pieces(page, field)
    whole: dict[int | tuple, tuple[str, str]] = {}
    for i, (kind, content, leaf) in enumerate(pieces):
        owner = leaf.owner if kind == "item" and leaf.owner >= 0 else (i,)
        if content:
            whole[owner] = (kind, f"{whole[owner][1]} {content}" if owner in whole else content)
    cases = {("markup", name): None for name in sorted(languages)}
    return list(cases | dict.fromkeys(case for case in whole.values() if case[0] in ("heading", "item", "code", "formula")))


def clean_text(page: str | None, field: ChainField) -> str:
    """The page without markup: headings after #, items after -, code in fences, formulas between dollar signs, cells between bars."""
    if not page or not page.strip():
        return ""
    pieces, languages = _pieces(page, field)
    out, end = "", 0
    begun: set[int] = set()
    for kind, content, leaf in pieces:
        gap = page[end : leaf.start].count("\n")
        end = max(end, leaf.end)
        if kind == "text":
            text = squeezed(of_running(leaf.body if leaf.shape == "line" else page[leaf.start : leaf.end], languages))
        elif kind == "code":
            body = leaf.body.strip("\n")
            text = "```\n" + (of_html(body) if leaf.shape == "pre" else body) + "\n```"
        elif kind == "other":
            text = "\n".join(table_rows(leaf.shape, leaf.body))
        else:
            more = kind == "item" and leaf.owner in begun
            text = ("" if more else {"heading": "# ", "item": "- ", "formula": "$"}.get(kind, "")) + content + ("$" if kind == "formula" else "")
            text = text if content else ""
            if kind == "item" and content and leaf.owner >= 0:
                begun.add(leaf.owner)
        if text and not leaf.around:
            joint = "\n\n" if gap > 1 or kind in ("heading", "code") else "\n" if gap or kind == "item" else " "
            out += (joint if out else "") + text
    return out


def page_elements(pages: DataFrame, page_id: str, contents: str) -> DataFrame:
    """(page id, kind, content) of the distinct cases of each page.

    Leaf blocks of a page get labels from a linear-chain conditional random field, by its element, the elements and shapes
    around it, its text and the page's other marks; the field is trained on pages written by rule (``training``) and
    decoded by Viterbi.  Contents are the leaves' text without markup.

    Pages are parsed whole, one at a time, in Arrow batches; the only shuffle drops repeated rows of the result.  Missing,
    empty and blank contents give no row; rows without page id are left out; a page given again counts once.
    """
    field = trained()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *case) for i, text in zip(batch["page_id"], batch["contents"], strict=True) for case in elements(text, field)]
            yield pd.DataFrame(rows, columns=["page_id", "kind", "content"])

    given = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(contents).alias("contents")).where("page_id is not null and contents is not null")
    return given.mapInPandas(parse, "page_id long, kind string, content string").dropDuplicates().withColumnRenamed("page_id", page_id)


def page_texts(pages: DataFrame, page_id: str, contents: str) -> DataFrame:
    """(page id, text): the clean text of every page, empty for a page without contents; a page given again counts once."""
    field = trained()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "text": [clean_text(x, field) for x in batch["contents"]]})

    given = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(contents).alias("contents")).where("page_id is not null")
    once = given.mapInPandas(parse, "page_id long, text string").dropDuplicates()
    return once.withColumnRenamed("page_id", page_id)
