"""Queries of the taxi rides: shifts, and zones and stands of dropoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.geojson import rough_area
from marlspike.functions.names import lower_name, upper_name
from marlspike.operators import trips
from marlspike.operators.sessions import sessionize
from marlspike.operators.spatial import locate
from marlspike.session import read

HOUR_MS = 3_600_000
YEAR_2000_MS = 946_684_800_000


def usable_rides(trips: DataFrame) -> DataFrame:
    """Rides with a licence, both times from 2000 on, that last from 0 to less than 4 hours."""
    named = trips.withColumn("license", upper_name("license"))
    lasting = F.col("dropofftime") - F.col("pickuptime")
    return named.where(F.col("license").isNotNull() & (F.col("pickuptime") >= YEAR_2000_MS) & (F.col("dropofftime") >= YEAR_2000_MS) & (lasting >= 0) & (lasting < 4 * HOUR_MS))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    rides = usable_rides(read(spark, directory, "trips").select("license", "pickuptime", "dropofftime"))
    return sessionize(rides, "license", "pickuptime", "dropofftime", 4 * HOUR_MS).select("license", "session_start", "session_end")


def p1_shifts(spark: SparkSession, directory: str) -> DataFrame:
    """Each shift with its length and its rides; a ride delivered again counts once."""
    rides = usable_rides(read(spark, directory, "trips").select("trip_id", "license", "pickuptime", "dropofftime")).dropDuplicates()
    return sessionize(rides, "license", "pickuptime", "dropofftime", 4 * HOUR_MS).withColumnsRenamed({"duration": "duration_ms", "events": "rides"})


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    rides, features = read(spark, directory, "trips"), read(spark, directory, "features")
    return locate(rides, features, "trip_id", "dropoffx", "dropoffy", "feature_id", "geometry", near_m=120)


def duration_hist(spark: SparkSession, directory: str) -> DataFrame:
    """Rides by whole hours, missing times counting 0."""
    rides = read(spark, directory, "trips").fillna(0, ["pickuptime", "dropofftime"])
    return trips.duration_histogram(rides, "pickuptime", "dropofftime")


def _placed(spark: SparkSession, directory: str) -> DataFrame:
    """Usable rides, each once, with the first zone of the dropoff: the least borough code, then the largest area."""
    rides = usable_rides(read(spark, directory, "trips").drop("loaded_at")).repartition("trip_id").dropDuplicates()
    zones = read(spark, directory, "features").where("geometry is not null and boroughcode is not null").withColumn("borough", lower_name("borough"))
    zones = zones.withColumn("area", rough_area("geometry"))
    # areal geometries only: a point holds nothing, unless a dropoff is the very point
    areal = zones.where(F.get_json_object("geometry", "$.type") != "Point")
    return trips.first_zone(rides, areal, "trip_id", "dropoffx", "dropoffy", [F.col("boroughcode"), -F.col("area")], "borough")


def zone_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """Usable rides by the borough of the dropoff."""
    return _placed(spark, directory).groupBy("borough").count()


def zone_lookup_located(spark: SparkSession, directory: str) -> DataFrame:
    """The same without rides that have a coordinate of 0 or none."""
    located = _placed(spark, directory)
    for c in ("pickupx", "pickupy", "dropoffx", "dropoffy"):
        located = located.where(F.col(c) != 0)
    return located.groupBy("borough").count()


def session_gaps(spark: SparkSession, directory: str) -> DataFrame:
    """How long licences stand idle after a dropoff, by its borough."""
    gaps = trips.chunked_gaps(_placed(spark, directory), "license", "pickuptime", "dropofftime", "borough", chunk=HOUR_MS * 6)
    return trips.gap_stats(gaps, "borough").select("borough", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


def event_gaps(spark: SparkSession, directory: str) -> DataFrame:
    """Seconds from one event of a user to the next, by the kind of the earlier."""
    events = read(spark, directory, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    gaps = trips.chunked_gaps(events, "user_id", "at", "at", "event_type", chunk=86_400_000_000, unit=1_000_000)
    return trips.gap_stats(gaps, "event_type").select("event_type", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_shifts, p5_found, duration_hist, zone_lookup, zone_lookup_located, session_gaps, event_gaps)}


_RIDES = """
rides as (
  select distinct trip_id, upper(trim(license, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) as license, pickuptime as p, dropofftime as d
  from trips
  where trim(license, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) <> '' and pickuptime >= 946684800000 and dropofftime >= 946684800000
    and dropofftime - pickuptime >= 0 and dropofftime - pickuptime < 14400000),
flagged as (
  select *, case when p <= max(d) over (partition by license order by p, d, trip_id rows between unbounded preceding and 1 preceding) + 14400000 then 0 else 1 end as fresh
  from rides),
numbered as (select *, sum(fresh) over (partition by license order by p, d, trip_id) as session from flagged)"""

_LOCATE = """
with recursive given as (select distinct feature_id, geometry::json as g from features where geometry is not null),
plain(feature_id, path, g) as (
  select feature_id, '' as path, g from given
  union all
  select feature_id, path || '/' || i, g->'geometries'->i
  from (select feature_id, path, g, unnest(range(json_array_length(g->'geometries')::bigint))::int as i from plain where g->>'type' = 'GeometryCollection')),
polygons as (
  select feature_id, path, g->'coordinates' as c from plain where g->>'type' = 'Polygon'
  union all
  select feature_id, path || '/' || i, g->'coordinates'->i
  from (select *, unnest(range(json_array_length(g->'coordinates')::bigint))::int as i from plain where g->>'type' = 'MultiPolygon')),
rings as (select feature_id, path, i as ring, c->i as c from (select *, unnest(range(json_array_length(c)::bigint))::int as i from polygons)),
corners as (select feature_id, path, ring, i, (c->i->>0)::double as x, (c->i->>1)::double as y from (select *, unnest(range(json_array_length(c)::bigint))::int as i from rings)),
edges as (
  select feature_id, path, ring, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from corners
  window w as (partition by feature_id, path, ring order by i)),
stands as (select feature_id, (g->'coordinates'->>0)::double as x, (g->'coordinates'->>1)::double as y from plain where g->>'type' = 'Point'),
drops as (select distinct trip_id, dropoffx as x, dropoffy as y from trips where dropoffx is not null and dropoffy is not null and not isnan(dropoffx) and not isnan(dropoffy)),
odd as (
  select trip_id, feature_id from drops join edges on (y1 > y) <> (y2 > y)
  where x < x1 + (x2 - x1) / (y2 - y1) * (y - y1)
  group by trip_id, feature_id, path having count(*) % 2 = 1),
close as (
  select trip_id, feature_id from drops d join stands s on d.y between s.y - 0.0011 and s.y + 0.0011
  where 2 * 6371000 * asin(sqrt(least(1, power(sin(radians(d.y - s.y) / 2), 2) + cos(radians(d.y)) * cos(radians(s.y)) * power(sin(radians(d.x - s.x) / 2), 2)))) <= 120)
select distinct trip_id, feature_id from (select * from odd union all select * from close)"""


_CUT = "trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))"
_PLACED = _LOCATE[: _LOCATE.index("stands as")] + f"""
rides as (
  select distinct trip_id, upper({_CUT.format('license')}) as license, pickuptime as p, dropofftime as d, pickupx, pickupy, dropoffx as x, dropoffy as y
  from trips where {_CUT.format('license')} <> '' and pickuptime >= 946684800000 and dropofftime >= 946684800000
    and dropofftime - pickuptime >= 0 and dropofftime - pickuptime < 14400000),
odd as (
  select trip_id, feature_id from rides join edges on (y1 > y) <> (y2 > y)
  where x < x1 + (x2 - x1) / (y2 - y1) * (y - y1)
  group by trip_id, feature_id, path having count(*) % 2 = 1),
sums as (select feature_id, path, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 as a from edges where x2 is not null group by all),
areas as (select feature_id, sum(case when ring = 0 then a else -a end) as area from sums group by 1),
named as (select feature_id, min(boroughcode) as code, min(lower({_CUT.format('borough')})) as borough from features where boroughcode is not null group by 1),
first as (
  select trip_id, borough from (select trip_id, borough, row_number() over (partition by trip_id order by code, area desc, feature_id) as i from odd join named using (feature_id) join areas using (feature_id)) where i = 1),
placed as (select rides.*, coalesce(borough, 'NA') as borough from rides left join first using (trip_id))"""


def oracles() -> dict[str, str]:
    return {
        "duration_hist": "select (coalesce(dropofftime, 0) - coalesce(pickuptime, 0)) // 3600000 as h, count(*) as count from trips group by 1",
        "zone_lookup": f"{_PLACED} select borough, count(*) as count from placed group by borough",
        "zone_lookup_located": f"{_PLACED} select borough, count(*) as count from placed where pickupx <> 0 and pickupy <> 0 and x <> 0 and y <> 0 group by borough",
        "session_gaps": f"{_PLACED}, gaps as (select borough, (lead(p) over (partition by license order by p, d) - d) // 1000 as seconds from placed) select borough, round(avg(seconds), 6) as mean, round(stddev_samp(seconds), 6) as stddev from gaps where seconds > 0 group by borough",
        "event_gaps": "with g as (select event_type, (lead(epoch_us(ts)) over (partition by user_id order by ts) - epoch_us(ts)) // 1000000 as seconds from events) select event_type, round(avg(seconds), 6) as mean, round(stddev_samp(seconds), 6) as stddev from g where seconds > 0 group by 1",
        "p1_found": f"with {_RIDES} select license, min(p) as session_start, max(d) as session_end from numbered group by license, session",
        "p1_shifts": f"with {_RIDES} select license, min(p) as session_start, max(d) as session_end, max(d) - min(p) as duration_ms, count(*) as rides from numbered group by license, session",
        "p5_found": _LOCATE,
    }
