import random

import pytest

from marlspike.llm.components import components
from marlspike.llm.cooccurrence import together
from marlspike.llm.density import DensityPeaks, peak_clusters, similarity_groups
from marlspike.llm.weighting import term_weights, top_terms

LINK = "a long, b long"


def union_find(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return sorted((top(x), x) for x in up)


def test_components(spark, rows):
    """Sparse random links, a chain, a star, and dirty rows, in one table."""
    draw = random.Random(8)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)]
    pairs += [(500 + i, 501 + i) for i in range(120)] + [(1000, 1000 + i) for i in range(1, 400)]
    pairs += [(2001, 2002), (2002, 2001), (2001, 2002), (2003, 2003), (None, 4), (5, None), (-7, 2005), (2**40, -(2**40))]
    assert rows(components(spark.createDataFrame(pairs, LINK), "a", "b")) == union_find(pairs)


def test_components_of_nothing(spark, rows):
    assert rows(components(spark.createDataFrame([], LINK), "a", "b")) == []
    clash = spark.createDataFrame([(2, 1, 5, "x")], "id_1 int, id_2 int, v int, group_id string")
    assert rows(components(clash, "id_1", "id_2")) == [(1, 1), (1, 2)]


def test_together(spark, rows):
    items = [(1, "A "), (1, "b"), (1, "B"), (1, None), (2, "a"), (2, "b"), (3, "c"), (3, " "), (4, "a"), (None, "a"), (5, " ")]
    pairs = [(1, ["B", "a"]), (1, ["a", " b "]), (2, ["a", "b"]), (2, ["a", "a"]), (2, ["a", None]), (2, None), (3, ["c"]), (None, ["a", "b"])]
    found = together(spark.createDataFrame(items, "r long, i string"), spark.createDataFrame(pairs, "r long, p array<string>"), "r", "i", "p")
    row = found.first()
    assert found.count() == 1 and tuple(row)[:6] == ("a", "b", 2, 3, 2, 4) and row["lift"] == pytest.approx(4 / 3) and row["llr"] > 0
    none = together(spark.createDataFrame([], "r long, i string"), spark.createDataFrame([], "r long, p array<string>"), "r", "i", "p")
    assert rows(none) == []


def test_weights(spark, rows):
    pages = [(1, ["x", "X ", "y", None, " "]), (1, ["x", "X ", "y", None, " "]), (2, ["y", "z"]), (3, None), (4, []), (5, ["b", "a"]), (None, ["q"])]
    table = spark.createDataFrame(pages, "id long, terms array<string>")
    plain = term_weights(table, "id", "terms", k1=None, rarity="smoothed")
    got = {(r["id"], r["term"]): (r["tf"], r["df"], r["length"], r["total"]) for r in plain.collect()}
    assert got[1, "x"] == (2, 1, 3, 5) and got[2, "y"] == (1, 2, 2, 5)
    assert rows(top_terms(plain, "id")) == [(1, "x"), (2, "z"), (5, "a")]
    weighted = {(r["id"], r["term"]): r["score"] for r in term_weights(table, "id", "terms").collect()}
    assert weighted[1, "x"] < 2 * weighted[5, "a"]
    assert rows(term_weights(table.limit(0), "id", "terms")) == []


def brute_groups(points):
    def similar(p, q):
        return all(max(a, b) + 1 <= 2 * (min(a, b) + 1) for a, b in zip(p, q, strict=True))

    ids = sorted(points)
    links = [(i, j) for i in ids for j in ids if i < j and similar(points[i], points[j])]
    return union_find(links)


@pytest.mark.parametrize("seed", range(1, 3))
def test_similarity_groups(spark, rows, seed):
    draw = random.Random(seed)
    spread = [3, 40, 3000][seed]
    points = {i: tuple(int(draw.random() ** 3 * spread) for _ in range(3)) for i in range(1, 260)}
    table = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(900, None, 1, 1), (901, -1, 1, 1), (None, 1, 1, 1), (1, *points[1])], "id long, p long, q long, r int")
    assert rows(similarity_groups(table, "id", ["p", "q", "r"])) == brute_groups(points)


def test_blocks_that_touch_in_two_fields_only(spark, rows):
    """Blocks whose bounds allow a link, with and without a record that makes it."""
    apart = {1: (4, 6), 2: (6, 4), 3: (7, 7 + 4), 4: (7 + 4, 7)}
    linked = {1: (4, 6), 2: (6, 6), 3: (13, 13)}
    for points in (apart, linked, {1: (2**62, 2**63 - 1), 2: (2**63 - 1, 2**62), 3: (0, 0), 4: (1, 0)}):
        table = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, p long, q long")
        assert rows(similarity_groups(table, "id", ["p", "q"])) == brute_groups(points)


def test_peaks(spark, rows):
    table = spark.createDataFrame([(i, 100 + i % 7, 5) for i in range(50)] + [(100 + i, 100000, 9) for i in range(3)], "id long, p long, q long")
    found = {r["cluster_id"]: r for r in peak_clusters(table, "id", ["p", "q"]).collect()}
    assert found[0]["size"] == 50 and found[100]["size"] == 3 and found[100]["typical"] == [100, 101, 102]
    assert rows(similarity_groups(table.limit(0), "id", ["p", "q"])) == []
    with pytest.raises(ValueError):
        DensityPeaks(table, "id", [])
