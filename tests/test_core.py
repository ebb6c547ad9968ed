import math

import pytest
from pyspark.sql import functions as F

from marlspike.functions import numeric
from marlspike.functions.names import lower_name
from marlspike.operators import classify, cluster, graph, profile, ranking, regions, risk, series, text, trips
from marlspike.scratch import Scratch
from marlspike.skew import hot_keys, running_sum, skew_join


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_golden_scalars(spark):
    assert [one(spark, numeric.hash_id(F.lit(x))) for x in ("abc", "Campylobacter", "é")] == [-5742139842178842224, 961486218088039104, -5572115130754409114]
    chi = [one(spark, numeric.chi_squared(*(F.lit(x) for x in row))) for row in ((5, 10, 8, 100), (1, 10, 8, 100), (8, 10, 8, 100))]
    assert chi == pytest.approx([20.667270531400966, 0.1358695652173913, 67.76871980676329])
    assert [one(spark, x) for x in numeric.featurized([F.lit(-0.04), F.lit(0.09)])] == pytest.approx([-0.0016, 0.0081, -0.2, 0.3, -0.04, 0.09])
    assert [risk.kupiec_statistic(100, f, 0.05) for f in (5, 8, 15)] == pytest.approx([0, 1.6158081904556667, 14.050010691305147])
    assert [risk.kupiec_p(100, f, 0.05) for f in (5, 8, 15)] == pytest.approx([1, 0.2036772675975879, 0.00017801282026])
    assert risk.kupiec_statistic(100, 0, 0.05) > 0 and risk.kupiec_statistic(100, 100, 0.05) > 0
    assert risk.interval_places(100, 0.05) == (1, 98)
    assert [one(spark, numeric.hours_between(F.lit(0), F.lit(x))) for x in (-3_600_001, -5, 14_399_999)] == [-1, 0, 3]
    assert one(spark, lower_name(F.lit("  A b "))) == "a b" and one(spark, lower_name(F.lit(" \t"))) is None


def test_scratch_and_skew(spark, rows):
    scratch = Scratch(spark)
    table, seen = scratch.save_observed(spark.range(10), F.count(F.lit(1)).alias("n"))
    assert table.count() == seen["n"] == 10
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 1)], "k int, v int")
    right = spark.createDataFrame([(i, i * 2) for i in range(0, 300, 2)] + [(1, 5)], "k int, w int")
    hot = hot_keys(left, "k", 0.1, least=1)
    assert hot == [1] and hot_keys(left, "k", 0.1) == []
    for how in ("inner", "left", "left_anti"):
        assert rows(skew_join(left, right, "k", hot, how)) == rows(left.join(right, "k", how))
    numbered = spark.range(100).selectExpr("id", "id div 7 as chunk", "id % 2 as k")
    summed = {(r["id"]): r["before"] for r in running_sum(numbered, ["k"], "chunk", ["id"], F.col("id"), "before").collect()}
    assert all(summed[i] == sum(j for j in range(i) if j % 2 == i % 2) for i in range(100))


def test_profile_and_crosstab(spark, rows):
    pairs = spark.createDataFrame([(1, 1.0, 1, 1, 1, 0, True), (3, 1.0, None, 1, 1, 1, True), (5, None, 0, 1, 0, 1, False)], "id int, lname double, plz int, byear int, bd int, bm int, is_match boolean")
    score = profile.score(["lname", "plz", "byear", "bd", "bm"])
    assert [r[0] for r in pairs.orderBy("id").select(score).collect()] == [4.0, 4.0, 2.0]
    assert rows(profile.crosstab(pairs.withColumn("o", F.col("is_match").cast("string")), score >= 4.0, "o", ["true", "false"])) == [(False, None, 1), (True, 2, None)]
    direct = profile.profile(pairs, ["lname", "plz"])
    by_text = profile.transposed(pairs.select("lname", "plz").describe(), "summary", ["lname", "plz"], profile.METRICS)
    assert rows(direct) == rows(by_text.select(direct.columns))
    assert rows(profile.count_of_counts(spark.createDataFrame([("a",), ("a",), ("b",)], "t string"), "t")) == [(1, 1), (2, 1)]


def test_ranking(spark, rows):
    counts = spark.createDataFrame([(1, 10, 1), (1, 11, 1), (2, 12, 3)], "user int, item int, n int")
    aliases = spark.createDataFrame([(11, 10), (11, 9), (None, 3)], "alias int, target int")
    assert rows(ranking.canonical(counts, "item", aliases, "alias", "target")) == [(1, 9, 1), (1, 10, 1), (2, 12, 3)]
    items = spark.range(200).selectExpr("id as item")
    mine = spark.createDataFrame([(u, i) for u in range(5) for i in range(u * 20, u * 20 + 15)], "user long, item long")
    found = rows(ranking.negatives(mine, "user", "item", items))
    assert len(found) == 75 and len(set(found)) == 75 and not set(found) & set(rows(mine))
    few = ranking.negatives(mine.where("user = 0"), "user", "item", spark.range(20).selectExpr("id as item"))
    assert sorted(r[1] for r in rows(few)) == [15, 16, 17, 18, 19]
    score = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0), (4, 3.0)], "item int, prediction double")
    good, bad = spark.createDataFrame([(1, 1), (1, 2), (1, 9)], "user int, item int"), spark.createDataFrame([(1, 3), (1, 4)], "user int, item int")
    auc = ranking.mean_auc(good, bad, lambda p: p.join(score, "item", "left").select("user", "item", "prediction"), "user")
    assert auc.first()[0] == pytest.approx(1 / 6)


def test_classes_and_clusters(spark, rows):
    said = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    assert rows(classify.confusion(said, "label", "prediction", [0, 1])) == [(0, 1, 1), (1, 0, 1), (2, 0, 1)]
    assert dict(rows(classify.priors(said, "label"))) == {0: 0.5, 1: 0.25, 2: 0.25}
    assert classify.random_accuracy(said, said.where("label < 2"), "label").first()[0] == pytest.approx(0.5 * 2 / 3 + 0.25 / 3)
    accuracy, f1 = classify.scores(said, "label", "prediction").first()
    assert accuracy == 0.5 and f1 == pytest.approx((2 * 2 / 3 + 1 * 0.5 + 0) / 4)
    hot = spark.createDataFrame([(0, 1, 0), (0, 0, 0)], "a int, b int, c int")
    assert sorted(r[0] for r in classify.decoded_one_hot(hot, {"g": ["a", "b", "c"]}).collect()) == [-1, 1]
    mixed = spark.createDataFrame([(1, "x")] * 3 + [(1, "y")] + [(2, "x"), (2, "y")], "c int, l string")
    assert cluster.label_entropy(mixed, "c", "l").first()[0] == pytest.approx(0.6059391565991873)
    far = spark.createDataFrame([(float(i // 2),) for i in range(10)], "distance double")
    assert cluster.anomalies(far, 3).count() == 4 and cluster.anomalies(far, 50).count() == 10


def test_graph(spark, rows):
    records = spark.createDataFrame([(["b", "a", "c"],), (["a", "b"],), (["a", "a"],), (["d"],), ([],)], "t array<string>")
    assert rows(graph.cooccurrences(records, "t")) == [("a", "a", 1), ("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 5), (7, 7)], "src long, dst long")
    ids = spark.createDataFrame([(9,)], "id long")
    assert rows(graph.connected_components(links, ids)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7), (9, 9)]
    assert rows(graph.triangles(links)) == [(1, 1), (2, 1), (3, 1)]
    assert dict(rows(graph.degrees(links)))[7] == 2
    assert graph.clustering_coefficient(links.where("src != dst"), spark.range(1, 8)).first()[0] == pytest.approx((1 + 1 + 1 / 3) / 7)
    paths = graph.path_lengths(links, spark.createDataFrame([(1,), (4,)], "id long"))
    assert rows(graph.pair_paths(paths)) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 4, 2), (3, 4, 1), (4, 4, 0)]
    chain = spark.range(60).selectExpr("id as src", "id + 1 as dst")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0}


def test_risk(spark, rows):
    prices = spark.createDataFrame([("s", "2020-01-06", 10.0), ("s", "2020-01-08", 12.0), ("s", "2020-01-13", 13.0)], "symbol string, date string, close double").withColumn("date", F.to_date("date"))
    assert [r[2] for r in risk.filled(prices, "symbol", "date", "close", "2020-01-06", "2020-01-13").orderBy("date").collect()] == [10, 10, 12, 12, 12]
    late = risk.filled(prices.where("close > 11"), "symbol", "date", "close", "2020-01-06", "2020-01-13")
    assert [r[2] for r in late.orderBy("date").collect()] == [12] * 5
    ten = spark.range(10).selectExpr("'s' as symbol", "id as date", "double(id + 1) as close")
    assert [r[2] for r in risk.window_returns(ten, "symbol", "date", "close").collect()] == [9.0]
    hundred = spark.range(1, 101).selectExpr("double(id) as value")
    assert risk.value_at_risk(hundred) == 5.0
    assert risk.tail_mean(hundred).first()[0] == 3.0
    assert risk.tail_mean(hundred.where("value = 7")).first()[0] == 7.0
    import numpy as np

    def draw(n):
        return risk.trial_returns(spark, np.array([[0.0, 0, 0, 0, 0, 1, 1]]), np.zeros(2), np.eye(2), n, 4)

    assert sorted(map(tuple, draw(1000).collect())) == sorted(map(tuple, draw(1000).collect())) and draw(1001).count() == 1001
    assert draw(20000).agg(F.stddev("value")).first()[0] == pytest.approx(math.sqrt(2), rel=0.03)


def test_regions(spark, rows):
    schema = "contig string, start long, end long"
    a = spark.createDataFrame([("c", 0, 10), ("c", 95, 205), ("d", 0, 10), ("c", 5, 5)], schema)
    b = spark.createDataFrame([("c", 10, 20), ("c", 9, 11), ("c", 100, 300), ("c", 150, 160)], schema)
    met = regions.overlaps(a, b, bin_size=50)
    assert rows(met.select("start", "r_start")) == [(0, 9), (95, 100), (95, 150)]
    kept = regions.overlaps(a, b, "left", 50).select("contig", "start", "r_start")
    assert rows(kept) == [("c", 0, 9), ("c", 5, None), ("c", 95, 100), ("c", 95, 150), ("d", 0, None)]
    near = regions.nearest(a, b, "contig", "start", "start")
    assert rows(near.select("contig", "start", "distance")) == [("c", 0, 9), ("c", 5, 4), ("c", 95, 5), ("d", 0, None)]
    far = regions.nearest(spark.createDataFrame([("c", 10_000_000)], "k string, p long"), spark.createDataFrame([("c", 3), ("c", 90_000_000)], "k string, q long"), "k", "p", "q")
    assert far.first()["distance"] == 9_999_997
    weights = regions.motif(["ACG", "ACG"], 0.0)
    found = spark.createDataFrame([("TTCGTAA",), ("AC",), ("ACGN",), (None,)], "s string").select(regions.motif_score(F.col("s"), weights))
    assert [r[0] for r in found.collect()] == [1.0, None, None, None]
    genome = spark.createDataFrame([("c", "ACGT" * 60)], "contig string, seq string")
    conserved = spark.createDataFrame([("c", 96, 99, 1.0), ("c", 98, 104, 3.0)], schema + ", score double")
    made = regions.binding_rows(a, b, conserved, genome, b.select("contig", "start"), weights, "F", "L").collect()
    assert [(r["start"], r["label"], r["phylop_avg"], r["pwm_score"]) for r in made] == [(95, True, 2.0, 1.0)]


def test_series(spark, rows):
    cells = spark.createDataFrame([(t, 0, 0, 0, v) for t, v in enumerate([3.0, 1.0, 1.0, 3.0])] + [(0, 1, 0, 0, 5.0)], "t int, x int, y int, z int, value double")
    whole = series.to_series(cells)
    assert rows(series.stats(whole, "series", "x")) == [(0, 2.0, 1.0, 3.0, 1), (1, 5.0, 0.0, 5.0, 0)]
    assert rows(series.to_images(whole)) == rows(cells)
    assert series.lively(whole, "series").count() == 1
    assert rows(series.histogram(spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "v double"), "v", 2)) == [(0, 1), (1, 2)]


def test_text_and_trips(spark, rows):
    got = spark.createDataFrame([("The cities were running, The abc1 of it",)], "t string")
    assert got.select(text.terms(F.col("t"), ["the"])).first()[0] == ["city", "were", "run"]
    assert "the" in got.select(text.terms(F.col("t"), ["the"], lower_first=False)).first()[0]
    raw = spark.createDataFrame([("a", "2013-01-01 00:00:10", None, "1.5", "x", None, "2")], "hack_license string, pickup_datetime string, dropoff_datetime string, pickup_longitude string, pickup_latitude string, dropoff_longitude string, dropoff_latitude string")
    assert rows(trips.parse_trips(raw)) == [("a", 1356998410000, 0, 1.5, 0.0, 0.0, 2.0)]
    assert trips.rejected_trips(raw).count() == 1
    events = spark.createDataFrame([("a", 0, 1000, "p"), ("a", 5000, 6000, "q"), ("a", 500, 9000, "r"), ("b", 0, 1, "p"), ("a", 90000, 91000, "s")], "k string, s long, e long, l string")
    for chunk in (1000, 7000, 10**9):
        assert rows(trips.chunked_gaps(events, "k", "s", "e", "l", chunk)) == rows(trips.idle_gaps(events, "k", "s", "e", "l"))
