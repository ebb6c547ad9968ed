from pyspark.sql import functions as F

from marlspike.operators import classify, sampling
from marlspike.scratch import Scratch


def test_forest_in_a_session_that_has_observed(spark):
    rows, seen = Scratch(spark).save_observed(spark.range(400).selectExpr("cast(id % 20 as double) as x", "cast(id % 7 as double) as y", "cast(id % 20 > 9 as double) as label"), F.count(F.lit(1)).alias("n"))
    assert seen["n"] == 400
    model = classify.tuned_forest(rows, "label", gains=(0.0,), trees=(1, 3), depth=4, bins=32)
    assert classify.scores(model.transform(rows), "label", "prediction").first()["accuracy"] > 0.95 and len(model.validationMetrics) == 2
    tree = classify.tuned_tree(rows, "label", depths=(1, 4), bins=(40,), impurities=("gini",), gains=(0.0,))
    assert classify.scores(tree.transform(rows), "label", "prediction").first()["accuracy"] == 1.0


def test_samples(spark):
    table = spark.range(2000).selectExpr("id", "id % 500 as key")
    few = {r["key"] for r in sampling.bernoulli(table, "key", 0.1, 4).collect()}
    assert 20 < len(few) < 90 and sampling.bernoulli(table, "key", 0.1, 4).count() == 4 * len(few)
    parts = sampling.split(table, "id", [3.0, 1.0], 2)
    a, b = ({r["id"] for r in p.collect()} for p in parts)
    assert not a & b and len(a | b) == 2000 and 1350 < len(a) < 1650
    assert sampling.take(table, "id", 7).count() == 7 and sampling.take(table.limit(0), "id", 7).count() == 0
