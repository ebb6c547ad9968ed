"""Graphs of topics that occur together: pairs, significance, components, degrees, triangles and path lengths."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.numeric import chi_squared, hash_id
from marlspike.scratch import Scratch
from marlspike.skew import hot_keys, skew_join


def major_topics(record: Column) -> Column:
    """The descriptors of an XML citation marked as major topics."""
    return F.xpath(record, F.lit('//DescriptorName[@MajorTopicYN="Y"]/text()'))


def record_pairs(topics: Column) -> Column:
    """The distinct pairs (a, b), a <= b, of one record's topics as an array; (a, a) only if a comes twice."""
    ordered = F.array_sort(F.filter(topics, lambda t: t.isNotNull()))
    pairs = F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.greatest(F.size(ordered) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.array_distinct(F.flatten(pairs))


def cooccurrences(records: DataFrame, topics: str) -> DataFrame:
    """(a, b, cnt): in how many records each two topics are together. Records are short lists; a record's pairs are made in its row."""
    return records.select(F.explode(record_pairs(F.col(topics))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("cnt"))


def topic_counts(records: DataFrame, topics: str) -> DataFrame:
    """(topic, cnt): how many times each topic occurs."""
    return records.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("cnt"))


def vertices(topics: DataFrame, topic: str) -> DataFrame:
    """(id, name) of each topic."""
    return topics.select(F.col(topic).alias("name")).where("name is not null").distinct().select(hash_id(F.col("name")).alias("id"), "name")


def edges(pairs: DataFrame) -> DataFrame:
    """(src, dst, cnt) with src <= dst, from (a, b, cnt)."""
    x, y = hash_id(F.col("a")), hash_id(F.col("b"))
    return pairs.select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), "cnt")


def chi_squared_edges(counted: DataFrame, sizes: DataFrame, total: int | DataFrame) -> DataFrame:
    """(src, dst, chi2) of edges (src, dst, cnt), with the vertices' counts (id, cnt) and the number of records."""
    a, b = sizes.select(F.col("id").alias("src"), F.col("cnt").alias("n_src")), sizes.select(F.col("id").alias("dst"), F.col("cnt").alias("n_dst"))
    hot = hot_keys(counted.select(F.explode(F.array("src", "dst")).alias("v")), "v")
    met = skew_join(skew_join(counted, a, "src", hot), b, "dst", hot)
    whole = F.lit(total)
    return met.select("src", "dst", chi_squared(F.col("cnt"), F.col("n_src"), F.col("n_dst"), whole).alias("chi2"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def connected_components(links: DataFrame, vertex_ids: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that can be reached, for each end of an edge and each of ``vertex_ids``.

    Every edge is moved, in turns, to the smallest neighbour of its greater end and of its lesser one, until stars around
    the smallest ids are left; the number of turns grows with the logarithm of a component's size.
    """
    scratch = Scratch(links.sparkSession)
    marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"))
    star, seen = scratch.save_observed(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct(), *marks)
    while seen["n"]:
        # neighbours that are greater than a vertex, and itself, move to its smallest neighbour
        around = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        greater = skew_join(around, least, "u", hot_keys(around, "u", total=2 * seen["n"])).where("v > u")
        large, counted = scratch.save_observed(greater.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), *marks)
        # smaller neighbours of a vertex, and itself, move to the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = skew_join(large, small_least, "u", hot_keys(large, "u", total=counted["n"]))
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        small, turned = scratch.save_observed(small, *marks)
        scratch.drop(large)
        if turned == seen:  # equal counts and sums of hashes: the same edges
            break
        scratch.drop(star)
        star, seen = small, turned
    labels = star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("id"), F.col("v").alias("component")))
    ends = links.select(F.explode(F.array("src", "dst")).alias("id"))
    everyone = ends if vertex_ids is None else ends.unionByName(vertex_ids.select("id"))
    return everyone.distinct().join(labels.distinct(), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def degrees(links: DataFrame) -> DataFrame:
    """(id, degree): edges at a vertex, an edge to itself counting twice."""
    return links.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def triangles(links: DataFrame) -> DataFrame:
    """(id, triangles) of vertices in a triangle.

    Each edge points from the end with fewer neighbours to the other, so that two edges out of one vertex are joined only
    where it has few: at most the root of twice the edges, also at a vertex that meets all others.
    """
    scratch = Scratch(links.sparkSession)
    once = scratch.save(links.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x != y").distinct())
    degree = once.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    hot = hot_keys(once.select(F.explode(F.array("x", "y")).alias("v")), "v")
    ranked = skew_join(once, degree.select(F.col("id").alias("x"), F.col("d").alias("dx")), "x", hot)
    ranked = skew_join(ranked, degree.select(F.col("id").alias("y"), F.col("d").alias("dy")), "y", hot)
    forward = F.struct("dx", "x") < F.struct("dy", "y")
    out = ranked.select(F.when(forward, F.col("x")).otherwise(F.col("y")).alias("s"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("t"), F.when(forward, F.col("dy")).otherwise(F.col("dx")).alias("dt"))
    out = scratch.save(out)
    p, q = out.select("s", F.col("t").alias("t1"), F.col("dt").alias("d1")), out.select("s", F.col("t").alias("t2"), F.col("dt").alias("d2"))
    wedges = p.join(q, "s").where(F.struct("d1", "t1") < F.struct("d2", "t2"))
    closed = wedges.join(out.select(F.col("s").alias("t1"), F.col("t").alias("t2")), ["t1", "t2"])
    return closed.select(F.explode(F.array("s", "t1", "t2")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering_coefficient(links: DataFrame, vertex_ids: DataFrame) -> DataFrame:
    """(coefficient): the mean over all vertices of triangles by the possible ones; 0 for fewer than two neighbours."""
    once = links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src != dst").distinct()
    each = degrees(once).join(triangles(once), "id", "left")
    parts = each.where("degree > 1").agg(F.sum(F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1) / 2)).alias("s"))
    everyone = vertex_ids.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    return everyone.join(F.broadcast(parts), F.lit(True)).select((F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("coefficient"))


def path_lengths(links: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(landmark, id, dist): edges on the shortest way from each landmark to every vertex it reaches, itself included.

    A round takes one step from the vertices reached last; ends when none is new.
    """
    scratch = Scratch(links.sparkSession)
    ways = scratch.save(_both_ways(links).where("src != dst").distinct())
    reached = [scratch.save(landmarks.select(F.col("id").alias("landmark"), "id").distinct().withColumn("dist", F.lit(0)))]
    before, front = None, reached[0]
    for step in itertools.count(1):
        following = front.select("landmark", F.col("id").alias("src"))
        met = ways.join(following, "src")  # an inner join: AQE splits a crowded vertex's edges
        new = met.select("landmark", F.col("dst").alias("id")).distinct().join(front.select("landmark", "id"), ["landmark", "id"], "left_anti")
        if before is not None:  # a new vertex is a neighbour of the last round's, so it can only have been in the last two
            new = new.join(before.select("landmark", "id"), ["landmark", "id"], "left_anti")
        table, counted = scratch.save_observed(new.withColumn("dist", F.lit(step)), F.count(F.lit(1)).alias("n"))
        if not counted["n"]:
            break
        before, front = front, table
        reached.append(table)
    whole = reached[0]
    for table in reached[1:]:
        whole = whole.unionByName(table)
    return whole


def pair_paths(paths: DataFrame) -> DataFrame:
    """(a, b, dist), a <= b: each pair once, whichever end was the landmark."""
    return paths.select(F.least("landmark", "id").alias("a"), F.greatest("landmark", "id").alias("b"), "dist").distinct()


def number_stats(df: DataFrame, column: str) -> DataFrame:
    """(count, mean, stdev, max, min) of a column; the deviation is that of a population."""
    return df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("stdev"), F.max(column).cast("double").alias("max"), F.min(column).cast("double").alias("min"))
