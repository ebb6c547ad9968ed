"""GeoJSON geometries as rows: rings of areal parts as edges, and points."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES = "feature_id long, kind string, part int, x1 double, y1 double, x2 double, y2 double"


def _number(value) -> float:
    return float(value)


def _geometries(value) -> Iterator[dict]:
    """The plain geometries in a geometry, collection of them, feature or collection of features."""
    if not isinstance(value, dict):
        return
    for field in ("geometries", "features"):
        if isinstance(value.get(field), list):
            for inner in value[field]:
                yield from _geometries(inner)
    if value.get("type") == "Feature":
        yield from _geometries(value.get("geometry"))
    elif "coordinates" in value:
        yield value


def areas_and_points(text: str | None) -> tuple[list[list[list[tuple[float, float]]]], list[tuple[float, float]]]:
    """The areal parts (each a list of rings, the first the outer one) and the points of a geometry.

    Missing or broken texts have none, nor have lines.  Further coordinates than two are ignored.
    """
    areas: list = []
    points: list = []
    try:
        value = json.loads(text) if text else None
    except (ValueError, TypeError):
        return areas, points
    for geometry in _geometries(value):
        kind, at = geometry.get("type"), geometry.get("coordinates")
        try:
            if kind == "Point" and at:
                points.append((_number(at[0]), _number(at[1])))
            elif kind == "MultiPoint":
                points.extend((_number(p[0]), _number(p[1])) for p in at)
            elif kind in ("Polygon", "MultiPolygon"):
                for polygon in [at] if kind == "Polygon" else at:
                    rings = [[(_number(p[0]), _number(p[1])) for p in ring] for ring in polygon]
                    areas.append([ring for ring in rings if len(ring) >= 3])
        except (TypeError, IndexError, ValueError):
            continue
    return areas, points


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ``mapInPandas`` over (feature_id, geometry): one row per edge (kind area) or point (kind point)."""
    for batch in batches:
        rows = []
        for feature, text in zip(batch["feature_id"], batch["geometry"], strict=True):
            areas, points = areas_and_points(text)
            for part, rings in enumerate(areas):
                for ring in rings:
                    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
                    rows += [(feature, "area", part, *a, *b) for a, b in zip(closed, closed[1:], strict=False) if a != b]
            rows += [(feature, "point", len(areas) + i, x, y, x, y) for i, (x, y) in enumerate(points)]
        yield pd.DataFrame(rows, columns=["feature_id", "kind", "part", "x1", "y1", "x2", "y2"])


def area(text: str | None) -> float:
    """The area of a geometry in the square of its unit, holes left out."""
    total = 0.0
    for rings in areas_and_points(text)[0]:
        for i, ring in enumerate(rings):
            closed = [*ring, ring[0]]
            size = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(closed, closed[1:], strict=False))) / 2
            total += -size if i else size
    return total


def rough_area(geometry: str) -> Column:
    """The planar area of a column of geometries."""

    @F.pandas_udf("double")
    def areas(texts: pd.Series) -> pd.Series:
        return texts.map(area).astype(float)

    return areas(F.col(geometry))
