"""Rounds of jobs for graphs that would fit into one task, and comparisons of fronts in shares."""

import random

import numpy as np
import pytest

from marlspike.llm import components, density
from test_groups import brute_groups, union_find


def test_levels_of_jobs(spark, rows, monkeypatch):
    monkeypatch.setattr(components, "FEW_EDGES", 40)
    draw = random.Random(9)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 90)]
    assert rows(components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")) == union_find(pairs)


def test_only_messages_are_shuffled(spark):
    """A round's join of the edges with the vertices that moved has no exchange on the edges' side."""
    scratch = components.Scratch(spark)
    both, _ = scratch.save_bucketed(spark.range(1000).selectExpr("id % 100 as src", "id as dst"), "src")
    state, _ = scratch.save_bucketed(spark.range(100).selectExpr("id as v", "true as moved"), "v")
    plan = both.hint("merge").join(state.where("moved").selectExpr("v as src"), "src")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_one_task(seed):
    draw = np.random.default_rng(seed)
    a, b = np.concatenate([draw.integers(0, 400, 260), np.arange(1000, 1200)]), np.concatenate([draw.integers(0, 400, 260), np.arange(1001, 1201)])
    keep = a != b
    names, found = components.decomposed(a[keep], b[keep], seed)
    tops = {v: c for c, v in union_find(list(zip(a[keep].tolist(), b[keep].tolist())))}
    groups = {}
    for v, c in zip(names.tolist(), found.tolist()):
        groups.setdefault(c, set()).add(tops[v])
    assert set(names.tolist()) == set(tops) and all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(tops.values()))


def test_fronts_in_shares(spark, rows, monkeypatch):
    """Records none of which exceeds another, more than one share holds, with and without a link."""
    monkeypatch.setattr(density, "FRONT_ROWS", 8)
    low = [(64 + i, 127 - i) for i in range(60)]
    for high in ([(128 + 2 * i, 254 - 2 * i) for i in range(60)], [(254 - 2 * i, 254 - 2 * i) for i in range(5)]):
        points = dict(enumerate(low + high, 1))
        table = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, p long, q long")
        assert rows(density.similarity_groups(table, "id", ["p", "q"])) == brute_groups(points)


def test_outermost():
    draw = np.random.default_rng(5)
    for columns in (1, 2, 4):
        points = draw.integers(0, 12, (900, columns))
        kept = density._outermost(points)
        whole = {tuple(p) for p in points}
        want = {p for p in whole if not any(q != p and all(x >= y for x, y in zip(q, p)) for q in whole)}
        assert sorted(map(tuple, points[kept])) == sorted(want)


def test_peaks_are_dense_and_far(spark):
    """A dense block far from the denser one is a peak of its own, a thin one at the same distance is not."""
    def clusters(n):
        points = [(i, 64, 5) for i in range(60)] + [(100 + i, 400, 5) for i in range(n)] + [(900, 127, 5), (901, 128, 5), (902, 255, 5)]
        points += [(2000 + i, 3, 2 ** (3 * i + 6)) for i in range(15)]
        return density.DensityPeaks(spark.createDataFrame(points, "id long, p long, q long"), "id", ["p", "q"]).decision.collect()

    thin, dense = clusters(1), clusters(50)
    assert sum(r["is_peak"] for r in thin) < sum(r["is_peak"] for r in dense)
    assert all(r["is_peak"] for r in thin if r["delta"] is None)
