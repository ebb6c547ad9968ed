import json
import math
import random

from marlspike.functions.geojson import area, areas_and_points
from marlspike.operators.spatial import locate

POINT = "trip_id long, x double, y double"
FEATURE = "feature_id int, geometry string"
SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]


def shape(kind, at):
    return json.dumps({"type": kind, "coordinates": at})


def found(spark, points, features, **more):
    table = locate(spark.createDataFrame(points, POINT), spark.createDataFrame(features, FEATURE), "trip_id", "x", "y", "feature_id", "geometry", 120, **more)
    return sorted(map(tuple, table.collect()))


def test_holes_borders_corners_and_parts(spark):
    features = [
        (1, shape("Polygon", [SQUARE, HOLE])),
        (2, shape("MultiPolygon", [[SQUARE], [[[2.0, 2.0], [6.0, 2.0], [6.0, 6.0], [2.0, 6.0], [2.0, 2.0]]]])),
        (3, shape("LineString", SQUARE)),
        (4, json.dumps({"geometries": [{"coordinates": [SQUARE], "type": "Polygon"}], "type": "GeometryCollection"})),
        (5, "{broken"),
        (6, None),
        (None, shape("Polygon", [SQUARE])),
        (1, shape("Polygon", [SQUARE, HOLE])),
        (7, shape("Polygon", [[[0, 0, 9], [2, 2, 9], [4, 0, 9]]])),
    ]
    points = [(1, 0.5, 0.5), (2, 2.0, 2.5), (3, 5.0, 5.0), (4, 0.0, 2.0), (5, 4.0, 4.0), (6, 9.0, 1.0), (7, 1.0, 1.0), (1, 0.5, 0.5), (8, None, 1.0), (9, float("nan"), 1.0), (None, 1.0, 1.0)]
    want = [(1, 1), (1, 2), (1, 4), (1, 7), (2, 2), (2, 4), (3, 2), (4, 1), (4, 2), (4, 4), (5, 1), (5, 2), (5, 4), (7, 1), (7, 2), (7, 4), (7, 7)]
    assert found(spark, points, features) == want
    assert found(spark, points, features, broadcast_rows=0) == want


def test_random_polygons_against_brute_force(spark):
    draw = random.Random(4)
    features = []
    for i in range(12):
        x, y, n = draw.uniform(-3, 3), draw.uniform(-3, 3), draw.randint(3, 9)
        turns = sorted(draw.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [[x + draw.uniform(0.3, 2) * math.cos(t), y + draw.uniform(0.3, 2) * math.sin(t)] for t in turns]
        features.append((i, shape("Polygon", [ring + ring[:1]])))
    points = [(i, draw.uniform(-5, 5), draw.uniform(-5, 5)) for i in range(400)]

    def inside(px, py, ring):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > py) != (y2 > py) and px < x1 + (x2 - x1) / (y2 - y1) * (py - y1):
                hit = not hit
        return hit

    want = sorted((p, f) for p, x, y in points for f, g in features if inside(x, y, json.loads(g)["coordinates"][0]))
    assert found(spark, points, features) == want


def test_near_places_over_the_globe(spark):
    metre = math.degrees(1 / 6_371_000)
    features = [(1, shape("Point", [179.9999, 60.0])), (2, shape("MultiPoint", [[10.0, 89.9999], [0.0, 0.0, 5.0]]))]
    points = [(1, 179.9999, 60 + 119 * metre), (2, 179.9999, 60 + 121 * metre), (3, -179.9999, 60.0), (4, -170.0, 89.9999), (5, 119 * metre, 0.0), (6, 121 * metre, 0.0), (7, 0.0, 100.0)]
    assert found(spark, points, features) == [(1, 1), (3, 1), (4, 2), (5, 2)]


def test_empty_tables(spark):
    assert found(spark, [], [(1, shape("Polygon", [SQUARE]))]) == []
    assert found(spark, [(1, 1.0, 1.0)], []) == []


def test_geometry_reading():
    assert areas_and_points(None) == ([], [])
    assert areas_and_points(shape("Polygon", None)) == ([], [])
    assert area(shape("Polygon", [SQUARE, HOLE])) == 12.0
