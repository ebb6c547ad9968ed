"""Inputs beyond every limit the operators once had."""

import pytest

from marlspike.llm import cooccurrence
from marlspike.llm.cooccurrence import together
from marlspike.llm.mixing import Mix
from marlspike.llm.tokens import STRETCH, VOCABULARY, _count, encoding
from marlspike.llm.weighting import term_weights


@pytest.mark.parametrize("text", ["hello" * 30_000, "word\t" * 44_259, "https://a.example/" + "a/b-c?d=" * 9_000, "x" * 200_000, "a b  c\n\n d" * 20_000, "é ü " * 40_000])
def test_tokens_of_long_texts_are_those_of_the_whole(text):
    tokenizer = encoding(VOCABULARY)
    assert _count(text, tokenizer) == len(tokenizer.encode_ordinary(text))


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n"])
def test_tokens_of_long_runs_of_blanks(blank):
    tokenizer = encoding(VOCABULARY)
    run = blank * STRETCH
    for text in (run, f"{run}a", f"a{run}", f"a{run}b c{run} d", "a" * STRETCH + run + "b"):
        assert _count(text, tokenizer) == len(tokenizer.encode_ordinary(text))
    assert _count(blank * 3_000_000 + "a", tokenizer) > 0


def test_mix_of_ten_thousand_sources(spark):
    n = 10_001
    sizes = spark.range(n).selectExpr("id", "concat('s', id) as source", "40L as n")
    targets = spark.range(n).selectExpr("concat('S', id) as source", f"1.0D / {n} as target_share", "if(id = 7, 0, 1) as max_repeats")
    report = {r["source"]: r for r in Mix(sizes, "id", "source", "n", targets).report().collect()}
    assert len(report) == n and sum(r["slots"] for r in report.values()) == 40 * n // 6
    assert report["s7"]["short"] and report["s7"]["reached"] == 0 and report["s8"]["slots"] in (6, 7)


def test_mix_before_the_first_empty_slot_keeps_the_shares(spark):
    sizes = spark.range(1000).selectExpr("id", "if(id < 900, 'big', 'small') as source", "100L as n")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in Mix(sizes, "id", "source", "n", targets).report().collect()}
    assert report["small"]["short"] and not report["big"]["short"] and report["small"]["empty_slots"] > 0
    assert report["big"]["actual_share"] > 0.6 and abs(report["big"]["balanced_share"] - 0.5) < 0.01
    more = targets.union(spark.createDataFrame([("gone", 0.25, 3)], targets.schema))
    report = {r["source"]: r for r in Mix(sizes, "id", "source", "n", more).report().collect()}
    assert report["gone"]["short"] and report["gone"]["reached"] == 0 and abs(report["big"]["balanced_share"] - 0.5) < 0.01


def test_stripes_in_many_shares_and_flushes(spark, rows, monkeypatch):
    monkeypatch.setattr(cooccurrence, "STRIPE_NEIGHBOURS", 3)
    monkeypatch.setattr(cooccurrence, "HELD", 50)
    lists = [[f"t{(i * k) % 23}" for k in range(1, 7)] for i in range(120)]
    items = [(i, t) for i, names in enumerate(lists) for t in names]
    pairs = [(i, [x, y]) for i, names in enumerate(lists) for x in names for y in names]
    want = {}
    for names in lists:
        for x in set(names):
            for y in set(names):
                if x < y:
                    want[x, y] = want.get((x, y), 0) + 1
    for least in (1, 8):
        found = together(spark.createDataFrame(items, "r long, i string"), spark.createDataFrame(pairs, "r long, p array<string>"), "r", "i", "p", least)
        assert {(r["item_a"], r["item_b"]): r["n"] for r in found.collect()} == {k: n for k, n in want.items() if n >= least}
        assert all(r["n_a"] == sum(r["item_a"] in names for names in lists) for r in found.collect())


def test_weights_of_a_very_long_record(spark):
    table = spark.createDataFrame([(1, [f"w{i % 5000}" for i in range(20_000)]), (2, ["w1"])], "id long, terms array<string>")
    found = term_weights(table, "id", "terms").where("id = 1")
    assert found.count() == 5000 and {r["tf"] for r in found.collect()} == {4}
