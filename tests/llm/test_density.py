from marlspike.llm.density import group_profiles, peak_clusters


def test_blocks_that_are_linked_in_two_fields_share_a_peak(spark):
    linked, apart = [(1, 2, 2), (2, 3, 3)], [(11, 3, 6), (12, 6, 3), (13, 13, 13)]
    for points, sizes in ((linked, [2]), (apart, [1, 2])):
        table = spark.createDataFrame(points, "id long, p long, q long")
        assert sorted(r["size"] for r in peak_clusters(table, "id", ["p", "q"]).collect()) == sizes


def test_typical_members_are_of_the_whole_cluster(spark, rows):
    """The record nearest to the middle of the densest block lies in another block."""
    points = [(i, 6, 3 if i % 2 else 6) for i in range(1, 13)] + [(20, 7, 4), (30, 9000, 9000)]
    table = spark.createDataFrame(points, "id long, p long, q long")
    found = {r["cluster_id"]: (r["size"], r["typical"]) for r in peak_clusters(table, "id", ["p", "q"]).collect()}
    assert found[1][0] == 13 and found[1][1][0] == 20
    assert [(r["group_id"], r["size"], r["typical"][0]) for r in group_profiles(table, "id", ["p", "q"]).collect()] == [(1, 13, 20)]
