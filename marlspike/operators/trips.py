"""Rides: parsing, lengths, idle time between rides, and the first zone of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.numeric import hours_between
from marlspike.operators.spatial import locate


def parse_time(text: Column) -> Column:
    """Milliseconds of a ``yyyy-MM-dd HH:mm:ss`` time in the session's zone; 0 for missing or broken ones."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0))


def parse_trips(raw: DataFrame) -> DataFrame:
    """(license, pickuptime, dropofftime, pickupx, pickupy, dropoffx, dropoffy) of a table of text; missing numbers are 0."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))

    return raw.select(
        F.col("hack_license").alias("license"),
        parse_time(F.col("pickup_datetime")).alias("pickuptime"),
        parse_time(F.col("dropoff_datetime")).alias("dropofftime"),
        number("pickup_longitude").alias("pickupx"),
        number("pickup_latitude").alias("pickupy"),
        number("dropoff_longitude").alias("dropoffx"),
        number("dropoff_latitude").alias("dropoffy"),
    )


def rejected_trips(raw: DataFrame) -> DataFrame:
    """Rows whose times or coordinates are there but can't be read."""
    bad = F.lit(False)
    for name in ("pickup_datetime", "dropoff_datetime"):
        bad |= F.col(name).isNotNull() & F.try_to_timestamp(F.col(name), F.lit("yyyy-MM-dd HH:mm:ss")).isNull()
    for name in ("pickup_longitude", "pickup_latitude", "dropoff_longitude", "dropoff_latitude"):
        bad |= F.col(name).isNotNull() & F.col(name).try_cast("double").isNull()
    return raw.where(bad)


def duration_histogram(trips: DataFrame, start: str, end: str) -> DataFrame:
    """(h, count): rides by whole hours."""
    return trips.groupBy(hours_between(F.col(start), F.col(end)).alias("h")).count().orderBy("h")


def first_zone(points: DataFrame, zones: DataFrame, point_id: str, x: str, y: str, order: list[Column], name: str, missing: str = "NA") -> DataFrame:
    """``points`` with ``name`` of the first zone, in the order of the zones' columns ``order``, that holds each, or ``missing``.

    A point id comes once in ``points``.  Points that are partitioned by it aren't shuffled again.
    """
    ranked = zones.select("feature_id", "geometry", F.col(name).alias("_name"), *(o.alias(f"_o{i}") for i, o in enumerate(order)))
    hits = locate(points, ranked, point_id, x, y, "feature_id", "geometry", near_m=0.0, unique=True)
    keys = ranked.select("feature_id", F.struct(*(f"_o{i}" for i in range(len(order))), "feature_id", "_name").alias("_key")).groupBy("feature_id").agg(F.min("_key").alias("_key"))
    first = hits.join(keys, "feature_id").groupBy(point_id).agg(F.min("_key").alias("_key"))
    return points.join(first, point_id, "left").withColumn(name, F.coalesce("_key._name", F.lit(missing))).drop("_key")


def idle_gaps(events: DataFrame, key: str, start: str, end: str, label: str, unit: int = 1000) -> DataFrame:
    """(label, seconds): from the end of each event to the start of the key's next, under the label of the earlier; gaps above 0.

    The next row is found by a window over the key.  Keys with a large part of all rows go through ``chunked_gaps``.
    """
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start, end))
    gap = ((following - F.col(end)) / unit).cast("long")
    return events.select(F.col(label), gap.alias("seconds")).where("seconds > 0")


def chunked_gaps(events: DataFrame, key: str, start: str, end: str, label: str, chunk: int, unit: int = 1000) -> DataFrame:
    """As ``idle_gaps``, with each key's time cut into chunks: a window per chunk, and one over the chunks' first rows.

    No task holds more rows of a key than one chunk has, or than it has chunks.
    """
    rows = events.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(label).alias("_l")).where("_k is not null and _s is not null")
    rows = rows.withColumn("_c", F.floor(F.col("_s") / chunk))
    firsts = rows.groupBy("_k", "_c").agg(F.min("_s").alias("_first"))
    nexts = firsts.select("_k", "_c", F.lead("_first").over(Window.partitionBy("_k").orderBy("_c")).alias("_next"))
    inner = rows.withColumn("_in", F.lead("_s").over(Window.partitionBy("_k", "_c").orderBy("_s", "_e")))
    gap = ((F.coalesce("_in", "_next") - F.col("_e")) / unit).cast("long")
    return inner.join(nexts, ["_k", "_c"]).select(F.col("_l").alias(label), gap.alias("seconds")).where("seconds > 0")


def gap_stats(gaps: DataFrame, label: str) -> DataFrame:
    """(label, mean, deviation of a sample) of the gaps."""
    return gaps.groupBy(label).agg(F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("stddev"))
