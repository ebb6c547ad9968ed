"""Points in regions and near places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.geojson import PIECES, pieces
from marlspike.scratch import Scratch

EARTH_M = 6_371_000.0
#: Strip rows of features that are broadcast at most, about 100 bytes each; beyond it the join is a salted shuffle.
BROADCAST_ROWS = 200_000
#: Shares a strip's points are split into where both sides are shuffled.
SALTS = 32


def haversine(x1: Column, y1: Column, x2: Column, y2: Column, radius: float = EARTH_M) -> Column:
    """Metres between two places given in degrees."""
    dy, dx = F.radians(y2 - y1) / 2, F.radians(x2 - x1) / 2
    a = F.sin(dy) * F.sin(dy) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.sin(dx) * F.sin(dx)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def locate(points: DataFrame, features: DataFrame, point_id: str, x: str, y: str, feature_id: str, geometry: str, near_m: float, broadcast_rows: int = BROADCAST_ROWS, unique: bool = False) -> DataFrame:
    """(point id, feature id) for each point inside an areal feature or at most ``near_m`` metres from a point feature.

    Crossing parity as a join: the edges of all rings are binned into latitude strips, a point meets only the edges in its
    own strip, and a ray to the east from it crosses an edge if the edge spans its latitude, the upper end left out, so
    that a corner counts once.  Crossings are counted by point, feature and part; an odd count is inside, which leaves
    holes out.  A point on an edge counts as inside: this is tested by itself.  Parts of one feature may overlap, each has
    its own count.  Point features lie in the strips within their distance and are compared over the globe.

    Strips are half the mean height of an edge, so an edge has three rows on average whatever the regions' size.  Points
    are shuffled once, by their id; repeated rows are dropped there, and both counts need no further shuffle while the
    strips' rows, counted first, are at most ``broadcast_rows``.  More of them are shuffled by strip, with the points of
    a strip in SALTS shares, so that a crowded strip is no single task.  With ``unique`` the caller knows that no point id
    comes twice, and points stay where they are: if they are partitioned by id already, nothing but strips is shuffled.

    Points without id or coordinate (null or NaN) and features without id are left out; broken, empty and missing
    geometries contain nothing.  A latitude beyond 90 degrees is no place on the globe, so near to nothing.  The same
    feature twice counts once.  Empty tables give an empty result.
    """
    scratch = Scratch(points.sparkSession)
    given = features.select(F.col(feature_id).cast("long").alias("feature_id"), F.col(geometry).alias("geometry")).where("feature_id is not null and geometry is not null").distinct()
    shape = scratch.save(given.mapInPandas(pieces, PIECES))
    extent = shape.agg(F.avg(F.when(F.col("kind") == "area", F.abs(F.col("y2") - F.col("y1")))).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    reach = math.degrees(near_m / EARTH_M) * (1 + 1e-9)
    height = max((extent["mean"] or 0) / 2, reach / 4, 1e-7)

    is_area = F.col("kind") == "area"
    low = F.least("y1", "y2") - F.when(is_area, 0.0).otherwise(reach)
    high = F.greatest("y1", "y2") + F.when(is_area, 0.0).otherwise(reach)
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    wide = F.when(F.abs("y1") + reach >= 89.999, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(math.radians(reach))) / F.cos(F.radians("y1"))))) * (1 + 1e-9))
    strips = shape.withColumns({"slope": slope, "wide": F.when(~is_area, wide)}).withColumn("strip", F.explode(F.sequence(F.floor(low / height), F.floor(high / height))))
    strips = strips.withColumnsRenamed({"feature_id": "_feature", "part": "_part"})

    ok = F.col("_id").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y") & F.col("_x").isNotNull() & F.col("_y").isNotNull()
    places = points.select(F.col(point_id).alias("_id"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(ok)
    places = (places if unique else places.repartition("_id").dropDuplicates()).withColumn("strip", F.floor(F.col("_y") / height))

    px, py = F.col("_x"), F.col("_y")
    spans = (F.col("y1") > py) != (F.col("y2") > py)
    crosses = is_area & spans & (px < F.col("x1") + F.col("slope") * (py - F.col("y1")))
    turn = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) - (F.col("y2") - F.col("y1")) * (px - F.col("x1"))
    on_edge = is_area & py.between(F.least("y1", "y2"), F.greatest("y1", "y2")) & px.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & (turn == 0)
    apart = F.abs(F.pmod(px - F.col("x1") + 540, F.lit(360.0)) - 180)
    near = ~is_area & (apart <= F.col("wide")) & (F.abs(py) <= 90) & (haversine(px, py, F.col("x1"), F.col("y1")) <= near_m)

    if scratch.save(strips.groupBy().count()).first()[0] <= broadcast_rows:
        met = places.join(F.broadcast(strips), (places["strip"] == strips["strip"]) & (crosses | on_edge | near))
    else:
        salted = places.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
        copies = strips.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(copies, (salted["strip"] == copies["strip"]) & (salted["salt"] == copies["salt"]) & (crosses | on_edge | near))
    counted = met.groupBy("_id", "_x", "_y", "_feature", "_part").agg(F.sum(F.when(crosses, 1).otherwise(0)).alias("crossings"), F.max(on_edge | near).alias("sure"))
    inside = counted.where((F.col("crossings") % 2 == 1) | F.col("sure"))
    return inside.groupBy("_id", "_feature").agg(F.lit(1).alias("one")).select(F.col("_id").alias(point_id), F.col("_feature").cast(features.schema[feature_id].dataType).alias(feature_id))
