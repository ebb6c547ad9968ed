"""Queries of this package, and the same in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm.components import components
from marlspike.llm.cooccurrence import together
from marlspike.llm.density import group_profiles, peak_clusters, similarity_groups
from marlspike.llm.markup.pages import page_elements, page_texts
from marlspike.llm.mixing import Mix
from marlspike.llm.packing import pack, split_items
from marlspike.llm.reading import band_of, reading_levels
from marlspike.llm.tokens import token_sizes
from marlspike.llm.weighting import term_weights, top_terms
from marlspike.functions.names import lower_name
from marlspike.session import read

FIELDS = ["duration", "src_bytes", "dst_bytes", "count"]


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return page_elements(read(spark, directory, "doctexts"), "page_id", "contents")


def p2_texts(spark: SparkSession, directory: str) -> DataFrame:
    return page_texts(read(spark, directory, "doctexts"), "page_id", "contents")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    links = read(spark, directory, "matchdata").where("is_match")
    found = components(links, "id_1", "id_2")
    return found.select(F.col("group_id").cast("int"), F.col("record_id").cast("int"))


def p3_group_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p3_found(spark, directory).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def p4_pairs(spark: SparkSession, directory: str, min_records: int = 1) -> DataFrame:
    found = together(read(spark, directory, "topics"), read(spark, directory, "topic_pairs"), "citation_id", "topic", "pairs", min_records)
    return found.withColumnsRenamed({"item_a": "topic_a", "item_b": "topic_b"})


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return p4_pairs(spark, directory, min_records=4).where("lift >= 5").select("topic_a", "topic_b")


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    weights = term_weights(read(spark, directory, "doctermmatrix"), "page_id", "terms", k1=None, rarity="smoothed")
    return top_terms(weights.where("length >= 2"), "page_id")


def p6_relevance(spark: SparkSession, directory: str) -> DataFrame:
    """The term that saturating relevance weights rank first on each page, and its score."""
    weights = term_weights(read(spark, directory, "doctermmatrix"), "page_id", "terms")
    best = weights.groupBy("page_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("best"))
    return best.select("page_id", "best.term", F.round(-F.col("best.s"), 6).alias("score"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return similarity_groups(read(spark, directory, "kddcup"), "conn_id", FIELDS)


def p7_clusters(spark: SparkSession, directory: str) -> DataFrame:
    return peak_clusters(read(spark, directory, "kddcup"), "conn_id", FIELDS)


def p7_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Size and typical members of each group of p7_found."""
    return group_profiles(read(spark, directory, "kddcup"), "conn_id", FIELDS)


def _packed(spark: SparkSession, directory: str) -> tuple[DataFrame, int]:
    capacity = read(spark, directory, "containers").agg(F.max("capacity_tokens")).first()[0]
    return pack(token_sizes(read(spark, directory, "documents"), "doc_id", "text"), "doc_id", "n_tokens", capacity), capacity


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return split_items(_packed(spark, directory)[0], "doc_id")


def p8_packed(spark: SparkSession, directory: str) -> DataFrame:
    """(doc_id, piece, n_tokens, container) of all documents."""
    return _packed(spark, directory)[0]


def p8_fill(spark: SparkSession, directory: str) -> DataFrame:
    """How full the containers are, all together."""
    packed, capacity = _packed(spark, directory)
    filled = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return filled.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"))


def _mix(spark: SparkSession, directory: str) -> Mix:
    sizes = token_sizes(read(spark, directory, "documents"), "doc_id", "text", "source")
    return Mix(sizes, "doc_id", "source", "n_tokens", read(spark, directory, "mix_targets"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return _mix(spark, directory).report().where("short").select("source")


def p9_report(spark: SparkSession, directory: str) -> DataFrame:
    return _mix(spark, directory).report()


def p9_mixed(spark: SparkSession, directory: str) -> DataFrame:
    return _mix(spark, directory).mixed()


def _english_levels(spark: SparkSession, directory: str) -> DataFrame:
    english = read(spark, directory, "documents").where(lower_name("lang").isin("en", "eng", "english"))
    return reading_levels(english, "doc_id", "text").withColumn("band", band_of(F.col("level")))


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return _english_levels(spark, directory).select("doc_id", "band")


def p10_profile(spark: SparkSession, directory: str) -> DataFrame:
    """How many texts each level has."""
    return _english_levels(spark, directory).groupBy("level", "band").agg(F.count(F.lit(1)).alias("texts"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_texts, p3_found, p3_group_sizes, p4_found, p4_pairs, p6_found, p6_relevance, p7_found, p7_clusters, p7_groups, p8_found, p8_packed, p8_fill, p9_found, p9_report, p9_mixed, p10_found, p10_profile)}


_GROUPS = """
links as (select id_1 as a, id_2 as b from matchdata where is_match and id_1 <> id_2),
edges as (select a, b from links union select b, a from links),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
found as (select min(b) as group_id, a as record_id from (select a, b from reach union select a, a from reach) group by a)"""

_NAME = "lower(trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)))"

_TOGETHER = f"""
named as (select distinct citation_id as c, {_NAME.format('topic')} as t from topics where {_NAME.format('topic')} <> '' and citation_id is not null),
each as (select t, count(*) as n from named group by t),
total as (select count(distinct c) as total from named),
two as (select a.c, a.t as topic_a, b.t as topic_b from named a join named b on a.c = b.c and a.t < b.t),
both_of as (select topic_a, topic_b, count(*) as n from two group by topic_a, topic_b),
counted as (
  select topic_a, topic_b, b.n, x.n as n_a, y.n as n_b, total
  from both_of b join each x on x.t = topic_a join each y on y.t = topic_b, total)"""

_XLX = "case when ({0}) > 0 then ({0}) * ln(({0})::double) else 0 end"

_WEIGHTS = f"""
pages as (select page_id, arg_max(terms, (coalesce(len(terms), 0), terms)) as terms from doctermmatrix where page_id is not null group by page_id),
entries as (select page_id, {_NAME.format('x')} as term from (select page_id, unnest(terms) as x from pages) where {_NAME.format('x')} <> ''),
counts as (select page_id, term, count(*) as k from entries group by page_id, term),
lengths as (select page_id, sum(k) as length from counts group by page_id),
spread as (select term, count(*) as d from counts group by term),
whole as (select (select count(*) from pages)::double as n, (select avg(length) from lengths) as mean)"""


_FIELDS = ["duration", "src_bytes", "dst_bytes", "count"]
_SIMILAR = " and ".join(f"greatest(x.{f}, y.{f}) + 1 <= 2 * (least(x.{f}, y.{f}) + 1)" for f in _FIELDS)
#: Records with as many binary digits of each field's value plus one are all similar, so such blocks may be linked for them.
_SIMILARITY = f"""
given as (select distinct conn_id, {', '.join(_FIELDS)} from kddcup where conn_id is not null and {' and '.join(f'{f} >= 0' for f in _FIELDS)}),
placed as (select *, {" || '/' || ".join(f'length(bin({f}::bigint + 1))::varchar' for f in _FIELDS)} as block from given),
points as (select distinct block, {', '.join(_FIELDS)} from placed),
links as (select distinct x.block as a, y.block as b from points x join points y on x.block <> y.block and {_SIMILAR}),
reach as (select distinct block as a, block as b from points union select r.a, l.b from reach r join links l on r.b = l.a),
blocks as (select block, min(conn_id) as least, count(*) as n from placed group by block),
found as (select a as block, min(least) as group_id, sum(n)::bigint as size from reach join blocks on b = block group by a)"""


def oracles() -> dict[str, str]:
    parts = ["n", "n_a - n", "n_b - n", "total - n_a - n_b + n", "total"]
    sides = ["n_a", "total - n_a", "n_b", "total - n_b"]
    llr = "2 * (" + " + ".join(_XLX.format(p) for p in parts) + " - " + " - ".join(_XLX.format(s) for s in sides) + ")"
    return {
        "p7_found": f"with recursive {_SIMILARITY} select group_id, conn_id from placed join found using (block) where size > 1",
        "p3_found": f"with recursive {_GROUPS} select group_id, record_id from found",
        "p3_group_sizes": f"with recursive {_GROUPS} select size, count(*) as groups from (select count(*) as size from found group by group_id) group by size",
        "p4_found": f"with {_TOGETHER} select topic_a, topic_b from counted where n >= 4 and n::double * total / (n_a * n_b) >= 5",
        "p4_pairs": f"with {_TOGETHER} select topic_a, topic_b, n, n_a, n_b, total, n * total::double / (n_a * n_b::double) as lift, greatest(0.0, {llr}) as llr from counted",
        "p6_found": f"with {_WEIGHTS} select page_id, term from (select page_id, term, row_number() over (partition by page_id order by k * ln((n + 1) / (d + 1)) desc, term) as i from counts join spread using (term) join lengths using (page_id), whole where length >= 2) where i = 1",
        "p6_relevance": f"with {_WEIGHTS} select page_id, term, round(score, 6) as score from (select *, row_number() over (partition by page_id order by score desc, term) as i from (select page_id, term, k * 2.2 / (k + 1.2 * (0.25 + 0.75 * length / mean)) * ln(1 + (n - d + 0.5) / (d + 0.5)) as score from counts join spread using (term) join lengths using (page_id), whole)) where i = 1",
    }
