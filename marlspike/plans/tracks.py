"""Queries of regions, sequences and series over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.operators import regions, series
from marlspike.session import read

#: Weights of a motif of three letters, from five sites of it.
MOTIF = regions.motif(["ACG", "ACG", "AAG", "TCG", "ACA"])
SECOND = 1_000_000


def _hours(spark: SparkSession, directory: str, kind: str) -> DataFrame:
    """An hour from each event of a kind on, by user, in seconds."""
    events = read(spark, directory, "events").where(F.col("event_type") == kind)
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / SECOND)
    return events.select(F.col("user_id").cast("string").alias("contig"), start.alias("start"), (start + 3600).alias("end"), F.col("value").alias("score"), "event_id")


def region_overlap(spark: SparkSession, directory: str) -> DataFrame:
    """Hours of clicks with the hours of purchases of the same user that overlap them."""
    met = regions.overlaps(_hours(spark, directory, "click"), _hours(spark, directory, "purchase"), bin_size=10_000)
    return met.select("event_id", F.col("r_event_id").alias("other_id"))


def region_labels(spark: SparkSession, directory: str) -> DataFrame:
    """Whether an hour of a click overlaps one of a purchase, and the mean value of the views it overlaps."""
    clicks = _hours(spark, directory, "click")
    label = regions.overlaps(clicks, _hours(spark, directory, "purchase"), "left", 10_000).groupBy("event_id").agg(F.max(F.col("r_start").isNotNull()).alias("label"))
    scores = regions.overlaps(clicks, _hours(spark, directory, "view"), "inner", 10_000).groupBy("event_id").agg(F.round(F.avg("r_score"), 6).alias("mean"), F.min("r_score").alias("min"), F.max("r_score").alias("max"))
    return label.join(scores, "event_id")


def nearest_site(spark: SparkSession, directory: str) -> DataFrame:
    """Seconds from each click to the user's nearest purchase."""
    found = regions.nearest(_hours(spark, directory, "click"), _hours(spark, directory, "purchase"), "contig", "start", "start")
    return found.select("event_id", "distance")


def _sequences(spark: SparkSession, directory: str) -> DataFrame:
    """Names turned to letters of a sequence: every letter becomes one of four."""
    names = read(spark, directory, "part").select("p_partkey", F.upper("p_name").alias("name"))
    letters = F.translate(F.regexp_replace("name", "[^A-Z]", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    return names.select("p_partkey", letters.alias("seq"))


def pwm_max(spark: SparkSession, directory: str) -> DataFrame:
    """The best place of a motif on either strand."""
    found = _sequences(spark, directory)
    return found.select("p_partkey", F.round(regions.motif_score(F.col("seq"), MOTIF), 6).alias("best"), regions.reverse_complement(F.col("seq")).alias("other"))


def series_stats(spark: SparkSession, directory: str) -> DataFrame:
    found = series.stats(read(spark, directory, "embeddings"), "embedding", "vec_id")
    return found.select("vec_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("max", 6).alias("max"), "argmin")


def _cells(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors as the pixels of a stack: 50 a row, the components are moments."""
    vectors = read(spark, directory, "embeddings")
    place = {"x": (F.col("vec_id") % 50).cast("int"), "y": F.floor(F.col("vec_id") / 50).cast("int"), "z": F.lit(0)}
    return vectors.select(*(v.alias(n) for n, v in place.items()), F.posexplode("embedding").alias("t", "value"))


def stack_series(spark: SparkSession, directory: str) -> DataFrame:
    """Every fifth pixel's series, normalised by its mean absolute value, at its last moment."""
    pixels = series.strided(series.to_series(_cells(spark, directory)), {"x": 5, "y": 5, "z": 1})
    lively = series.lively(pixels, "series", 0.1)
    moved = series.normalized(F.transform("series", F.abs))
    return lively.select("x", "y", F.size("series").alias("moments"), F.round(F.element_at(moved, -1), 6).alias("last"), F.round(F.element_at(series.centred(F.col("series")), 1), 6).alias("first"))


def stack_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Pixels to images again: the sums of the images."""
    images = series.to_images(series.to_series(_cells(spark, directory)))
    return images.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def deviation_histogram(spark: SparkSession, directory: str) -> DataFrame:
    deviations = series.stats(read(spark, directory, "embeddings"), "embedding", "vec_id").select(F.round("std", 9).alias("std"))
    return series.histogram(deviations, "std", 20)


def _minutes(spark: SparkSession, directory: str, kind: str) -> DataFrame:
    """An hour from each event of a kind on, by user, in minutes since the first of January 2024."""
    start = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / SECOND - 1_704_067_200) / 60)
    events = read(spark, directory, "events").where(F.col("event_type") == kind)
    return events.select(F.col("user_id").cast("string").alias("contig"), start.alias("start"), (start + 60).alias("end"), F.col("value").alias("score"))


def binding_rows(spark: SparkSession, directory: str) -> DataFrame:
    """Training rows of hours of clicks: bound by purchases, conserved by views, on sequences made of the parts' names."""
    names = _sequences(spark, directory).where("seq != ''")
    genome = names.select(F.col("p_partkey").cast("string").alias("contig"), "seq")
    clicks, bought, seen = (_minutes(spark, directory, kind) for kind in ("click", "purchase", "view"))
    sites = _minutes(spark, directory, "signup").select("contig", "start")
    rows = regions.binding_rows(clicks, bought, seen, genome, sites, MOTIF, "F", "C", copies=8000)
    measured = {c: F.round(c, 6).alias(c) for c in ("pwm_score", "phylop_avg", "phylop_min", "phylop_max")}
    return rows.select("contig", "start", "end", *measured.values(), "closest_tss", "tf", "cell_line", "label")


def queries() -> dict:
    return {f.__name__: f for f in (region_overlap, region_labels, nearest_site, binding_rows, pwm_max, series_stats, stack_series, stack_round_trip, deviation_histogram)}


_EVENTS = "e as (select event_id, user_id, event_type, value, epoch_us(ts) // 1000000 as s from events)"
_CELLS = "cells as (select vec_id % 50 as x, vec_id // 50 as y, unnest(range(64)) as t, unnest(embedding)::double as v from embeddings)"


def oracles() -> dict[str, str]:
    letters = "translate(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
    weight = " * ".join(f"(case substr(seq, i::bigint + {k}, 1) " + " ".join(f"when '{b}' then {w}::double" for b, w in column.items()) + " end)" for k, column in enumerate(MOTIF))
    stats = "s as (select vec_id, avg(v) as mean, stddev_pop(v) as std, max(v) as max, arg_min(t, (v, t)) as argmin from (select vec_id, unnest(range(64)) as t, unnest(embedding)::double as v from embeddings) group by vec_id)"
    minutes = "e as (select user_id::varchar as contig, event_type as kind, floor((epoch_us(ts) / 1000000.0 - 1704067200) / 60)::bigint as s, value from events)"
    best = f"p as (select p_partkey::varchar as contig, repeat({letters}, 8000) as f from part where {letters} <> '')"
    scored = f"cut as (select contig, s, substr(f, s + 1, 60) as seq from (select distinct contig, s from peaks) join p using (contig)), both_ways as (select contig, s, seq from cut union all select contig, s, reverse(translate(seq, 'ACGT', 'TGCA')) from cut), w as (select contig, s, {weight} as v from (select *, unnest(range(1, 59)) as i from both_ways where length(seq) = 60)), motif as (select contig, s, max(v) as pwm from w group by 1, 2)"
    binding = f"""with {minutes}, {best},
peaks as (select contig, s from e where kind = 'click'),
labelled as (select a.contig, a.s, bool_or(b.s is not null) as label from peaks a left join e b on b.kind = 'purchase' and a.contig = b.contig and a.s < b.s + 60 and b.s < a.s + 60 group by 1, 2),
kept as (select a.contig, a.s, avg(b.value) as av, min(b.value) as lo, max(b.value) as hi from peaks a join e b on b.kind = 'view' and a.contig = b.contig and a.s < b.s + 60 and b.s < a.s + 60 group by 1, 2),
{scored},
met as (select l.contig, l.s, l.label, k.av, k.lo, k.hi from labelled l join kept k on l.contig = k.contig and l.s < k.s + 60 and k.s < l.s + 60),
near as (select m.contig, m.s, min(abs(m.s + 30 - t.s)) as d from (select distinct contig, s from met) m join e t on t.kind = 'signup' and t.contig = m.contig group by 1, 2)
select contig, s as start, s + 60 as "end", round(pwm, 6) as pwm_score, round(av, 6) as phylop_avg, round(lo, 6) as phylop_min, round(hi, 6) as phylop_max, d as closest_tss, 'F' as tf, 'C' as cell_line, label
from met join motif using (contig, s) left join near using (contig, s)"""
    return {
        "binding_rows": binding,
        "region_overlap": f"with {_EVENTS} select a.event_id, b.event_id as other_id from e a join e b on a.user_id = b.user_id and a.s < b.s + 3600 and b.s < a.s + 3600 where a.event_type = 'click' and b.event_type = 'purchase'",
        "region_labels": f"with {_EVENTS}, l as (select a.event_id, count(b.event_id) > 0 as label from e a left join e b on a.user_id = b.user_id and b.event_type = 'purchase' and a.s < b.s + 3600 and b.s < a.s + 3600 where a.event_type = 'click' group by 1), m as (select a.event_id, round(avg(b.value), 6) as mean, min(b.value) as min, max(b.value) as max from e a join e b on a.user_id = b.user_id and b.event_type = 'view' and a.s < b.s + 3600 and b.s < a.s + 3600 where a.event_type = 'click' group by 1) select * from l join m using (event_id)",
        "nearest_site": f"with {_EVENTS} select a.event_id, min(abs(a.s - b.s)) as distance from e a left join e b on a.user_id = b.user_id and b.event_type = 'purchase' where a.event_type = 'click' group by 1",
        "pwm_max": f"with p as (select p_partkey, {letters} as f, reverse(translate({letters}, 'ACGT', 'TGCA')) as r from part), b as (select p_partkey, f as seq from p union all select p_partkey, r from p), w as (select p_partkey, {weight} as s from (select *, unnest(range(1, length(seq)::bigint - 1)) as i from b)) select p_partkey, round(best, 6) as best, r as other from p left join (select p_partkey, max(s) as best from w group by 1) using (p_partkey)",
        "series_stats": f"with {stats} select vec_id, round(mean, 6) as mean, round(std, 6) as std, round(max, 6) as max, argmin from s",
        "stack_series": f"with {_CELLS}, p as (select x, y, count(*) as moments, stddev_pop(v) as d, avg(v) as m, avg(abs(v)) as a, max(v) filter (t = 0) as v0, max(abs(v)) filter (t = 63) as v63 from cells where x % 5 = 0 and y % 5 = 0 group by x, y) select x::int as x, y::int as y, moments::int as moments, round((v63 - a) / a, 6) as last, round(v0 - m, 6) as first from p where d >= 0.1",
        "stack_round_trip": f"with {_CELLS} select t::int as t, count(*) as n, round(sum(v), 4) as total from cells group by t",
        "deviation_histogram": f"with {stats}, r as (select round(std, 9) as std from s), m as (select min(std) as lo, max(std) as hi from r) select least(floor((std - lo) / (hi - lo) * 20), 19)::int as bin, count(*) as count from r, m group by 1",
    }
