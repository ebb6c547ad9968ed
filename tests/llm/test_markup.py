"""Pages written by hand: nesting, elements around leaves, hostile pages, and the kept weights."""

import time

import pytest

from marlspike.llm.markup.clean import of_latex, of_wiki
from marlspike.llm.markup.leaves import leaves
from marlspike.llm.markup.pages import clean_text, elements
from marlspike.llm.markup.training import SEED, fitted, labelled_page, trained


@pytest.fixture(scope="module")
def field():
    return trained()


def items(page, field):
    return [content for kind, content in elements(page, field) if kind == "item"]


def test_nesting_has_no_limit():
    deep = "x"
    for _ in range(60):
        deep = f"{{{{t|{deep}}}}}"
    assert of_wiki(f"a {deep} b").split() == ["a", "b"] and of_wiki("{{nowrap|a {{t}} b}}") == "a  b" and of_wiki("{{a") == "{{a"
    assert of_latex("\\textbf{a \\emph{b \\textit{c \\texttt{d \\textsc{e \\underline{f}}}}}}") == "a b c d e f"
    assert of_latex("\\footnote{see \\emph{x}}a \\href{http://b}{c \\emph{d}} {e} \\{f\\} {\\em g}") == "a c d {e} {f} g"
    assert of_latex("\\emph{open") == "\\emph{open"
    found = leaves("{{Infobox|a={{B|x={{C|y={{D|z={{E}}}}}}}}}}\n")
    assert [leaf.shape for leaf in found] == ["template"]


def test_leaves_know_the_elements_around_them():
    page = "<div><blockquote><ul>\n<li><p>one</p></li>\n<li>two<ol><li>three</li></ol>\nrest</li></ul></blockquote></div>\nafter"
    paths = {leaf.body.strip(): leaf.path for leaf in leaves(page)}
    assert paths["two"] == ("div", "blockquote", "ul") and paths["three"] == ("div", "blockquote", "ul", "li", "ol")
    assert paths["<p>one</p></li>"] == ("div", "blockquote", "ul", "li") and paths["after"] == ()
    owners = {leaf.body.strip(): leaf.owner for leaf in leaves(page)}
    assert owners["two"] == owners["rest</li></ul></blockquote></div>"] != owners["three"]


def test_items_of_several_blocks(field):
    assert items("<div><blockquote><ul><li><p>one <b>x</b></p></li>\n<li><p>two</p></li></ul></blockquote></div>", field) == ["one x", "two"]
    assert items("<ul><li>two<ol><li>three</li></ol>\nrest</li></ul>\n<p>Some other text follows here.</p>", field) == ["two rest", "three"]
    assert clean_text("<ul><li>a<ul><li>b</li></ul></li></ul>\n<p>Text that follows.</p>", field).split() == "- a - b Text that follows.".split()


@pytest.mark.parametrize("page, item", [("Head\n====\n\n- one\n- two $a_1$ three\n", "two $a_1$ three"), ("== H ==\n\n* [[one]]\n* two <math>x < y</math> three\n", "two")])
def test_formulas_in_items(field, page, item):
    found = elements(page, field)
    assert any(kind == "formula" for kind, _ in found) and any(c.startswith(item) for c in items(page, field))


def test_numbers_of_items_of_any_length(field):
    assert items("# A\n\n123456. one\n123457. two\n", field) == ["one", "two"]


OPENERS = ["\\begin{equation}", "\\[", "\\(", "<ref>", "<h2>", "<math>", "{{", "\\section{", "\\begin{tabular}", "\n{|", "<ref ", "$", "<ul><li>", "<!", "[[", "`", "\\emph{", "**", "{"]


@pytest.mark.parametrize("opener", OPENERS)
def test_hostile_pages_take_linear_time(field, opener):
    began = time.time()
    for page in (f"{opener} a " * 8000, f"{opener}a\n" * 8000):
        elements(page, field)
        clean_text(page, field)
    assert time.time() - began < 30
    began = time.time()
    leaves(f"{opener} a " * 8000)
    assert time.time() - began < 1.5


def test_kept_weights_are_those_of_the_fit(field):
    """The kept model labels unseen pages as a new fit does."""
    new = fitted(120)
    right = same = n = 0
    for i in range(60):
        features, gold = labelled_page((SEED + 2) * 1_000_000 + i)
        kept, fresh = field.decode(features), new.decode(features)
        right += sum(a == b for a, b in zip(kept, gold))
        same += sum(a == b for a, b in zip(kept, fresh))
        n += len(gold)
    assert right / n > 0.995 and same / n > 0.97


def test_languages_come_from_labels(field):
    """A field that calls every mark plain text finds no language in a page of paragraphs."""
    page = "One '''two''' and [[three]].\n\nFour <b>five</b>."
    assert {c for k, c in elements(page, field) if k == "markup"} == {"wiki", "html"}
    blind = type(field).from_dict(field.to_dict())
    blind.weights[:, blind.index["text"]] += 1e6
    assert elements(page, blind) == []
