from marlspike.operators import graph


def test_paths_of_more_than_a_hundred_steps(spark):
    chain = spark.range(102).selectExpr("id as src", "id + 1 as dst")
    found = {r["id"]: r["dist"] for r in graph.path_lengths(chain, spark.range(1)).collect()}
    assert found == {i: i for i in range(103)}
