"""Queries of customers and suppliers: aliases, popularity, ranking; and of part, event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.operators import profile, ranking, regions
from marlspike.scratch import Scratch
from marlspike.session import read


def _bought(spark: SparkSession, directory: str) -> DataFrame:
    """(user, item, n): how often a customer bought from a supplier."""
    orders = read(spark, directory, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    items = read(spark, directory, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("item"))
    return orders.join(items, "o_orderkey").groupBy("user", "item").agg(F.count(F.lit(1)).alias("n"))


def _aliases(spark: SparkSession, directory: str) -> DataFrame:
    """A part of each name stands for the others."""
    parts = read(spark, directory, "part")
    least = parts.groupBy("p_name").agg(F.min("p_partkey").alias("target"))
    return parts.join(least, "p_name").where("p_partkey != target").select(F.col("p_partkey").alias("alias"), "target")


def alias_canonical_counts(spark: SparkSession, directory: str) -> DataFrame:
    lines = read(spark, directory, "lineitem").select("l_partkey")
    return ranking.canonical(lines, "l_partkey", _aliases(spark, directory), "alias", "target").groupBy("l_partkey").count()


def popularity_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """Each customer's suppliers with their popularity."""
    bought = Scratch(spark).save(_bought(spark, directory))
    return ranking.popularity(bought, "user", "item", "n", bought.select("user", "item"))


def negative_items(spark: SparkSession, directory: str) -> DataFrame:
    bought = Scratch(spark).save(_bought(spark, directory))
    items = read(spark, directory, "supplier").select(F.col("s_suppkey").alias("item"))
    return ranking.negatives(bought, "user", "item", items)


def mean_auc(spark: SparkSession, directory: str) -> DataFrame:
    """How well popularity tells a customer's suppliers from others."""
    bought = Scratch(spark).save(_bought(spark, directory))
    items = read(spark, directory, "supplier").select(F.col("s_suppkey").alias("item"))
    others = ranking.negatives(bought, "user", "item", items)
    totals = Scratch(spark).save(ranking.item_totals(bought, "item", "n"))
    found = ranking.mean_auc(bought, others, lambda pairs: ranking.by_popularity(pairs, "user", "item", totals), "user")
    return found.select(F.round("mean_auc", 6).alias("mean_auc"))


def type_counts(spark: SparkSession, directory: str) -> DataFrame:
    return profile.class_balance(read(spark, directory, "part"), "p_type")


def json_property_count(spark: SparkSession, directory: str) -> DataFrame:
    events = read(spark, directory, "events").select(F.get_json_object("props", "$.k").alias("k"))
    return events.groupBy("k").count()


def union_labelled(spark: SparkSession, directory: str) -> DataFrame:
    """One table per kind of event, put together again."""
    events = read(spark, directory, "events")
    parts = [events.where(F.col("event_type") == kind).select("event_id", "value", F.lit(kind).alias("kind")) for kind in ("view", "click", "purchase")]
    return regions.union_all(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def union_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """As ``union_labelled``, with a table for every kind there is, and one for events without a kind."""
    events = read(spark, directory, "events").select("event_id", "value", F.col("event_type").alias("kind"))
    kinds = [r["kind"] for r in events.select("kind").distinct().collect()]  # a handful: one plan each
    parts = [events.where(F.col("kind").eqNullSafe(F.lit(kind))) for kind in kinds] or [events]
    return regions.union_all(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def queries() -> dict:
    return {f.__name__: f for f in (alias_canonical_counts, popularity_lookup, negative_items, mean_auc, type_counts, json_property_count, union_labelled, union_kinds)}


_BOUGHT = "bought as (select o_custkey as u, l_suppkey as i, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)"
_HASH = "('0x' || substr(md5({}::varchar), 1, 15))::bigint"
_NEGATIVES = f"""
ring as (select s_suppkey as i, row_number() over (order by {_HASH.format('s_suppkey')}, s_suppkey) - 1 as place, count(*) over () as total from supplier),
wanted as (select u, count(*) as p, {_HASH.format('u')} % (select max(total) from ring) as start from bought group by u),
near as (select u, p, ring.i, (ring.place - start + total) % total as step from wanted, ring where (ring.place - start + total) % total <= least(2 * p, total - 1)),
negs as (select u, i from (select n.u, n.i, p, row_number() over (partition by n.u order by step) as r from near n anti join bought b on b.u = n.u and b.i = n.i) where r <= p)"""


def oracles() -> dict[str, str]:
    return {
        "union_kinds": "select event_type as kind, count(*) as n, round(avg(value), 6) as mean, min(value) as min, max(value) as max from events group by 1",
        "alias_canonical_counts": "with m as (select p_partkey as alias, min(p_partkey) over (partition by p_name) as target from part) select coalesce(target, l_partkey) as l_partkey, count(*) as count from lineitem left join m on alias = l_partkey group by 1",
        "popularity_lookup": f"with {_BOUGHT}, t as (select i, sum(n)::bigint as prediction from bought group by i) select u as user, i as item, prediction from bought left join t using (i)",
        "negative_items": f"with {_BOUGHT}, {_NEGATIVES} select u as user, i as item from negs",
        "mean_auc": f"with {_BOUGHT}, {_NEGATIVES}, t as (select i, sum(n) as s from bought group by i), x as (select b.u, b.i, s from bought b join t using (i)), y as (select n.u, n.i, s from negs n left join t using (i)), k as (select x.u, avg(case when x.s > y.s then 1.0::double else 0 end) as auc from x join y on x.u = y.u group by x.u) select round(avg(auc), 6) as mean_auc from k",
        "type_counts": "select p_type, count(*) as count from part group by p_type",
        "json_property_count": "select json_extract_string(props, '$.k') as k, count(*) as count from events group by 1",
        "union_labelled": "select event_type as kind, count(*) as n, round(avg(value), 6) as mean, min(value) as min, max(value) as max from events where event_type in ('view', 'click', 'purchase') group by 1",
    }
