"""Stacks of images as one series per pixel, and statistics of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_series(cells: DataFrame) -> DataFrame:
    """(x, y, z, series) of (t, x, y, z, value), in the order of t."""
    ordered = F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("value"))))
    return cells.groupBy("x", "y", "z").agg(F.transform(ordered, lambda p: p["value"]).alias("series"))


def to_images(series: DataFrame) -> DataFrame:
    """(t, x, y, z, value) of (x, y, z, series)."""
    return series.select("x", "y", "z", F.posexplode("series").alias("t", "value")).select("t", "x", "y", "z", "value")


def mean(series: Column) -> Column:
    return F.try_divide(F.aggregate(series, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(series).cast("double"))


def deviation(series: Column) -> Column:
    """Of a population."""
    centre = mean(series)
    return F.sqrt(F.try_divide(F.aggregate(series, F.lit(0.0), lambda s, x: s + (x.cast("double") - centre) * (x.cast("double") - centre)), F.size(series).cast("double")))


def centred(series: Column) -> Column:
    centre = mean(series)
    return F.transform(series, lambda x: x.cast("double") - centre)


def normalized(series: Column, offset: float = 0.0) -> Column:
    """Change relative to the mean, (x - mean) / (mean + offset); null where that is 0."""
    centre = mean(series)
    return F.transform(series, lambda x: F.try_divide(x.cast("double") - centre, centre + offset))


def first_least(series: Column) -> Column:
    """The place, from 0, of the least value; the first of equal ones."""
    return (F.array_position(series, F.array_min(series)) - 1).cast("long")


def stats(df: DataFrame, series: str, *also: str) -> DataFrame:
    """(also..., mean, std, max, argmin) of each series."""
    s = F.col(series)
    return df.select(*also, mean(s).alias("mean"), deviation(s).alias("std"), F.array_max(s).cast("double").alias("max"), first_least(s).alias("argmin"))


def lively(df: DataFrame, series: str, least: float = 0.1) -> DataFrame:
    """Rows whose series has at least that deviation."""
    return df.where(deviation(F.col(series)) >= least)


def strided(df: DataFrame, steps: dict[str, int]) -> DataFrame:
    """Every n-th place of each axis."""
    for axis, step in steps.items():
        df = df.where(F.col(axis) % step == 0)
    return df


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, count) of equal widths between the least and the greatest value; the greatest falls into the last."""
    bounds = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    place = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    return df.where(F.col(column).isNotNull()).join(F.broadcast(bounds), F.lit(True)).groupBy(place.cast("int").alias("bin")).count()
