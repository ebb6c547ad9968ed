"""Queries of citations' topics as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.names import lower_name
from marlspike.operators import graph, profile
from marlspike.scratch import Scratch
from marlspike.session import read

#: Edges of the graph: pairs of topics whose chi squared exceeds this (the 0.001 % point and beyond).
CHI_SQUARED = 19.5


def _named(spark: SparkSession, directory: str, major: bool = True) -> DataFrame:
    rows = read(spark, directory, "topics").where("citation_id is not null")
    rows = rows.where("majortopicyn = 'Y'") if major else rows
    return rows.select("citation_id", lower_name("topic").alias("topic")).where("topic is not null").distinct()


def _records(spark: SparkSession, directory: str) -> DataFrame:
    """A row per citation with its major topics."""
    return _named(spark, directory).groupBy("citation_id").agg(F.collect_list("topic").alias("topics"))


def _pairs(spark: SparkSession, directory: str) -> DataFrame:
    return graph.cooccurrences(_records(spark, directory), "topics")


def _weighted(spark: SparkSession, directory: str) -> DataFrame:
    """(src, dst, chi2) of all pairs."""
    scratch = Scratch(spark)
    records, seen = scratch.save_observed(_records(spark, directory), F.count(F.lit(1)).alias("n"))
    counts = scratch.save(graph.topic_counts(records, "topics").select(graph.hash_id(F.col("topic")).alias("id"), "cnt"))
    pairs = scratch.save(graph.edges(graph.cooccurrences(records, "topics")))
    return graph.chi_squared_edges(pairs, counts, seen["n"])


def _strong(spark: SparkSession, directory: str) -> DataFrame:
    return Scratch(spark).save(_weighted(spark, directory).where(F.col("chi2") > CHI_SQUARED))


def _vertices(spark: SparkSession, directory: str) -> DataFrame:
    return Scratch(spark).save(graph.vertices(_named(spark, directory), "topic"))


def topic_distribution(spark: SparkSession, directory: str) -> DataFrame:
    return profile.class_balance(_named(spark, directory), "topic")


def count_of_counts(spark: SparkSession, directory: str) -> DataFrame:
    return profile.count_of_counts(_named(spark, directory, major=False), "topic", 10)


def topic_cooccurrence(spark: SparkSession, directory: str) -> DataFrame:
    return _pairs(spark, directory).select("a", "b", "cnt")


def top_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return _pairs(spark, directory).orderBy(F.desc("cnt"), "a", "b").limit(10)


def hash_vertices(spark: SparkSession, directory: str) -> DataFrame:
    return _vertices(spark, directory)


def chi_squared_edges(spark: SparkSession, directory: str) -> DataFrame:
    return _weighted(spark, directory).select("src", "dst", F.round("chi2", 4).alias("chi2"))


def topic_components(spark: SparkSession, directory: str) -> DataFrame:
    return graph.connected_components(_strong(spark, directory), _vertices(spark, directory))


def component_sizes(spark: SparkSession, directory: str) -> DataFrame:
    return topic_components(spark, directory).groupBy("component").count().orderBy(F.desc("count"), "component")


def topic_degrees(spark: SparkSession, directory: str) -> DataFrame:
    names = _vertices(spark, directory)
    return graph.degrees(_strong(spark, directory)).join(names, "id").select("name", "degree").orderBy(F.desc("degree"), "name")


def degree_stats(spark: SparkSession, directory: str) -> DataFrame:
    stats = graph.number_stats(graph.degrees(_strong(spark, directory)), "degree")
    return stats.select("count", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "max", "min")


def topic_triangles(spark: SparkSession, directory: str) -> DataFrame:
    return graph.triangles(_strong(spark, directory))


def clustering_coefficient(spark: SparkSession, directory: str) -> DataFrame:
    return graph.clustering_coefficient(_strong(spark, directory), _vertices(spark, directory)).select(F.round("coefficient", 6).alias("coefficient"))


def path_histogram(spark: SparkSession, directory: str) -> DataFrame:
    """Lengths of shortest ways from a fiftieth of the topics, drawn by their id, over the strong edges."""
    marks = _vertices(spark, directory).where("pmod(id, 50) = 0")
    paths = graph.pair_paths(graph.path_lengths(_strong(spark, directory), marks))
    return paths.where("dist > 0").groupBy("dist").count().orderBy("dist")


def queries() -> dict:
    return {f.__name__: f for f in (topic_distribution, count_of_counts, topic_cooccurrence, top_pairs, hash_vertices, chi_squared_edges, topic_components, component_sizes, topic_degrees, degree_stats, topic_triangles, clustering_coefficient, path_histogram)}


_NAME = "lower(trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)))"
_BYTES = " + ".join(f"(('0x' || substr(md5({{0}}), {2 * i + 1}, 2))::int::hugeint << {8 * i})" for i in range(8))


def _id(column: str) -> str:
    whole = _BYTES.format(column)
    return f"(case when ({whole}) >= 9223372036854775808::hugeint then ({whole}) - 18446744073709551616::hugeint else ({whole}) end)::bigint"


def oracles() -> dict[str, str]:
    named = f"""
every as (select distinct citation_id as c, {_NAME.format('topic')} as t, majortopicyn as m from topics where citation_id is not null and {_NAME.format('topic')} <> ''),
named as (select distinct c, t from every where m = 'Y'),
counts as (select t, count(*) as n from named group by t),
pairs as (select x.t as a, y.t as b, count(*) as cnt from named x join named y on x.c = y.c and x.t < y.t group by 1, 2),
total as (select count(distinct c)::double as total from named),
verts as (select {_id('t')} as id, t as name from counts)"""
    chi = f"""
weighted as (
  select least(i.id, j.id) as src, greatest(i.id, j.id) as dst,
    total * power(abs(cnt * (total - x.n - y.n + cnt) - (x.n - cnt)::double * (y.n - cnt)) - total / 2, 2) / (x.n::double * (total - x.n) * y.n * (total - y.n)) as chi2
  from pairs join counts x on x.t = a join counts y on y.t = b join verts i on i.name = a join verts j on j.name = b, total),
strong as (select src, dst from weighted where chi2 > {CHI_SQUARED}),
both_ways as (select src, dst from strong union select dst, src from strong)"""
    reach = """
reach as (select id as a, id as b from verts union select a, dst from reach join both_ways on b = src),
found as (select a as id, min(b) as component from reach group by a)"""
    degree = "degrees as (select id, count(*) as degree from (select src as id from strong union all select dst from strong) group by id)"
    corners = """
closed as (select x.src as p, x.dst as q, z.dst as r from both_ways x join both_ways y on x.src = y.src and x.dst < y.dst and x.src < x.dst join both_ways z on z.src = x.dst and z.dst = y.dst),
tri as (select id, count(*) as triangles from (select p as id from closed union all select q from closed union all select r from closed) group by id)"""
    paths = """
steps as (
  select id as a, id as b, 0 as dist from verts where ((id % 50) + 50) % 50 = 0
  union
  select a, dst, dist + 1 from steps join both_ways on b = src where dist < 8),
shortest as (select a, b, min(dist) as dist from steps group by a, b)"""
    return {
        "topic_distribution": f"with {named} select t as topic, n as count from counts",
        "count_of_counts": f"with {named}, k as (select t, count(*) as cnt from (select distinct c, t from every) group by t) select cnt, count(*) as dist from k group by cnt order by dist desc, cnt limit 10",
        "topic_cooccurrence": f"with {named} select a, b, cnt from pairs",
        "top_pairs": f"with {named} select a, b, cnt from pairs order by cnt desc, a, b limit 10",
        "hash_vertices": f"with {named} select id, name from verts",
        "chi_squared_edges": f"with {named}, {chi} select src, dst, round(chi2, 4) as chi2 from weighted",
        "topic_components": f"with recursive {named}, {chi}, {reach} select id, component from found",
        "component_sizes": f"with recursive {named}, {chi}, {reach} select component, count(*) as count from found group by component",
        "topic_degrees": f"with {named}, {chi}, {degree} select name, degree from degrees join verts using (id)",
        "degree_stats": f"with {named}, {chi}, {degree} select count(*) as count, round(avg(degree), 6) as mean, round(stddev_pop(degree), 6) as stdev, max(degree)::double as max, min(degree)::double as min from degrees",
        "topic_triangles": f"with {named}, {chi}, {corners} select id, triangles from tri",
        "clustering_coefficient": f"with {named}, {chi}, {degree}, {corners} select round((select coalesce(sum(coalesce(triangles, 0) / (degree * (degree - 1) / 2.0::double)), 0) from degrees left join tri using (id) where degree > 1) / (select count(*) from verts), 6) as coefficient",
        "path_histogram": f"with recursive {named}, {chi}, {paths}, u as (select distinct least(a, b) as a, greatest(a, b) as b, dist from shortest) select dist, count(*) as count from u where dist > 0 group by dist",
    }
