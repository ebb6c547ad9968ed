import math
import random

import numpy as np
import pytest

from marlspike.llm.markup.crf import ChainField
from marlspike.llm.markup.pages import clean_text, elements, page_elements, page_texts
from marlspike.llm.markup.training import SEED, labelled_page, trained
from marlspike.llm.mixing import Mix
from marlspike.llm.packing import pack, split_items, sum_of_squares
from marlspike.llm.reading import band_of, level_of, reading_levels
from marlspike.llm.tokens import VOCABULARY, encoding, token_sizes


@pytest.fixture(scope="module")
def field():
    return trained()


def test_field_sums_and_decodes_as_all_paths_do():
    field = ChainField(["a", "b"])
    data = [([["x"], ["y"], ["x"]], ["a", "b", "a"]), ([["y"], ["y"]], ["b", "b"])]
    field.fit([x for x, _ in data], [y for _, y in data], rounds=30)
    sequence = [["x"], ["y"], ["y"], ["x"]]
    scores = field._scores(sequence)
    paths = {p: field.first[p[0]] + sum(scores[i, k] for i, k in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False)) for p in np.ndindex(2, 2, 2, 2)}
    best = max(paths, key=paths.get)
    assert field.decode(sequence) == [field.labels[k] for k in best]
    single, _ = field._marginals(scores)
    whole = sum(math.exp(s) for s in paths.values())
    assert single[1, 0] == pytest.approx(sum(math.exp(s) for p, s in paths.items() if p[1] == 0) / whole)
    assert [field.decode(x) for x, _ in data] == [y for _, y in data] and field.decode([]) == []


def test_field_on_pages_it_has_not_seen(field):
    right = leaves = 0
    for i in range(100):
        features, gold = labelled_page((SEED + 1) * 1_000_000 + i)
        right += sum(a == b for a, b in zip(field.decode(features), gold, strict=True))
        leaves += len(gold)
    assert right / leaves > 0.995


CASES = [
    ("<h2 id='s'>\n A &amp; <b>b</b>\n</h2>\n<ul><li>one<ul><li>two</li></ul></li>\n<li>three</UL>", {("markup", "html"), ("heading", "A & b"), ("item", "one"), ("item", "two"), ("item", "three")}),
    ("<pre><code>if a &lt; b:\n  c</code></pre>", {("markup", "html"), ("code", "if a < b: c")}),
    ("== '''A''' [[x|b]] ==\n\n# one\n## two <ref>z</ref>\n# three\n\n: <math>x < y</math>", {("markup", "wiki"), ("heading", "A b"), ("item", "one"), ("item", "two"), ("item", "three"), ("formula", "x < y")}),
    ("#REDIRECT [[Other]]", {("markup", "wiki")}),
    ("Head\n=====\n\n- [ ] one **two**\n  - [x](http://a)\n\n```c\n# no head\n* no item\n```", {("markup", "markdown"), ("heading", "Head"), ("item", "one two"), ("item", "x"), ("code", "# no head * no item")}),
    ("\\section{A \\texttt{b} \\& c}\\label{s}\n\n\\begin{itemize}\n  \\item x\n  \\item y~\\cite{k}\n\\end{itemize}\nIt was $a^2$ and \\(b\\).", {("markup", "latex"), ("heading", "A b & c"), ("item", "x"), ("item", "y"), ("formula", "a^2"), ("formula", "b")}),
    ("It cost $12 at the gate and $30 at the pier. C:\\data\\x | 4 * 3 * 2 | R&D [3] x < 5.", set()),
    ("", set()),
    (None, set()),
    ("a" * 300_000, set()),
]


@pytest.mark.parametrize("page, want", CASES)
def test_elements(field, page, want):
    assert set(elements(page, field)) == want


def test_pages(spark, rows, field):
    table = spark.createDataFrame([(1, "# A\n\nText *b*.\n\n- c"), (1, "# A\n\nText *b*.\n\n- c"), (2, None), (None, "- x"), (3, " ")], "page_id long, contents string")
    assert ("item", "c") in {r[1:] for r in rows(page_elements(table, "page_id", "contents"))}
    assert len(rows(page_elements(table, "page_id", "contents"))) == 3
    assert {r[0]: r[1] for r in rows(page_texts(table, "page_id", "contents"))} == {1: "# A\n\nText b.\n\n- c", 2: "", 3: ""}
    assert rows(page_elements(table.limit(0), "page_id", "contents")) == []
    assert clean_text("<pre>\nx\n  y</pre>\n\n<p>a <i>b</i></p>", field).startswith("```\nx\n  y\n```")


@pytest.mark.parametrize(
    "page",
    ["<p>a <i>b</i></p><table><tr><td>c</td><td>4</td></tr><tr><td>d<td>7</tr></table>", "a ''b''\n\n{| class=\"w\"\n|-\n| c || 4\n|-\n| d || 7\n|}", "a **b**\n\n| c | 4 |\n|---|:-:|\n| d | 7 |", "a \\emph{b}\n\n\\begin{tabular}{ll}\nc & 4 \\\\\nd & 7 \\\\\n\\end{tabular}"],
)
def test_tables_in_clean_text(field, page):
    assert clean_text(page, field).split() == "a b c | 4 d | 7".split()


def test_tokens(spark, rows):
    table = spark.createDataFrame([(1, "A short text."), (2, None), (3, ""), (4, "a b " * 60_000), (5, "x" * 200_000)], "id long, text string")
    got = dict(rows(token_sizes(table, "id", "text")))
    tokenizer = encoding(VOCABULARY)
    assert got[1] == len(tokenizer.encode_ordinary("A short text.")) and got[2] == got[3] == 0
    assert got[4] == len(tokenizer.encode_ordinary("a b " * 60_000)) and got[5] > 0


def test_packing(spark, rows):
    draw = random.Random(2)
    sizes = [(i, draw.choice([0, 1, 5, 30, 64, 65, 100, 128, 300])) for i in range(400)] + [(1000, None), (None, 4), (7, 9)]
    packed = rows(pack(spark.createDataFrame(sizes, "id long, n long"), "id", "n", 64))
    fill, pieces = {}, {}
    for item, piece, size, container in packed:
        pieces.setdefault(item, []).append((piece, size))
        if container is not None:
            fill[container] = fill.get(container, 0) + size
    assert max(fill.values()) <= 64 and sum(fill.values()) == sum(n or 0 for i, n in sizes if i is not None)
    whole = dict(sizes)
    for item, parts in pieces.items():
        if item not in (None, 7):
            assert len(parts) == max(1, -(-(whole[item] or 0) // 64)) and [p for p, _ in sorted(parts)] == list(range(len(parts)))
    cut = sorted(r[0] for r in rows(split_items(pack(spark.createDataFrame(sizes, "id long, n long"), "id", "n", 64), "id")))
    assert cut == sorted(i for i, n in sizes if i is not None and n and n > 64)
    assert rows(pack(spark.createDataFrame([], "id long, n long"), "id", "n", 64)) == []


def test_sum_of_squares_wastes_little():
    draw = np.random.default_rng(1)
    for sizes in (draw.integers(1, 100, 3000), draw.integers(40, 60, 3000), np.full(100, 50)):
        bins = sum_of_squares(sizes, 100)
        fill = np.bincount(bins, weights=sizes)
        used = fill[fill > 0]
        assert used.max() <= 100 and used.sum() == sizes.sum()
    assert len(np.unique(sum_of_squares(np.full(100, 50), 100))) == 50
    even = sum_of_squares(draw.integers(1, 50, 5000), 100)
    assert len(np.unique(even)) < 5000 * 24.5 / 100 * 1.06


def test_mix(spark, rows):
    draw = random.Random(3)
    docs = [(i, draw.choice([" Big", "big", "big", "mid"]), draw.randint(1, 60)) for i in range(3000)] + [(9000 + i, "small", 50) for i in range(20)] + [(9900, None, 700), (9901, "other", 500), (9902, "big", None), (None, "big", 5)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("Small ", 0.2, 2), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = Mix(spark.createDataFrame(docs, "id long, source string, n long"), "id", "source", "n", targets, block_tokens=256)
    report = {r["source"]: r for r in mix.report().collect()}
    total = sum(n or 0 for i, _, n in docs if i is not None)
    assert report["small"]["short"] and not report["big"]["short"] and report["small"]["passes"] == 2
    assert abs(report["big"]["reached"] / total - 0.5) < 0.02 and abs(report["mid"]["reached"] / total - 0.3) < 0.02
    assert report["small"]["reached"] == 2000 and report["gone"]["reached"] == 0
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    uses = {}
    for r in mix.mixed().collect():
        uses[r["id"]] = uses.get(r["id"], 0) + 1
    assert max(n for i, n in uses.items() if i < 3000) <= 3 and all(uses[9000 + i] == 2 for i in range(20))
    first = [r["source"] for r in mix.schedule().orderBy("slot").limit(60).collect()]
    assert 27 <= first.count("big") + 0 <= 33
    empty = Mix(spark.createDataFrame([], "id long, source string, n long"), "id", "source", "n", targets)
    assert {r["reached"] for r in empty.report().collect()} == {0} and rows(empty.mixed()) == []


def test_levels(spark, rows):
    draw = random.Random(5)
    easy, hard = ["the cat sat", "a dog ran", "we see him", "it is red"], ["institutional interdependence characterizes", "epistemological considerations presuppose", "multidimensional infrastructures necessitate"]
    texts = [(i, " ".join(draw.choice(easy) + "." for _ in range(12))) for i in range(40)]
    texts += [(100 + i, " ".join(draw.choice(hard) for _ in range(12)) + ".") for i in range(40)]
    texts += [(200, "too short"), (201, None), (202, ""), (None, texts[0][1])]
    table = spark.createDataFrame(texts, "id long, text string")
    found = reading_levels(table, "id", "text")
    bands = {r[0]: r[1] for r in found.select("id", band_of(found["level"])).collect()}
    assert bands == {i: "easy" if i < 100 else "hard" for i, t in texts if i is not None and i < 200}
    assert rows(reading_levels(table.limit(0), "id", "text")) == []
    grades = spark.createDataFrame([(4.9,), (5.0,), (15.9,), (16.0,)], "g double")
    assert [r[0] for r in grades.select(band_of(level_of(grades["g"]))).collect()] == ["easy", "medium", "medium", "hard"]
