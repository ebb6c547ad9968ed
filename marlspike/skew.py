"""Joins that hold when one key has a large part of all rows, and running sums without a single large task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot above this part of all rows, so there are fewer than its inverse of them, whatever the data ...
HOT_SHARE = 1 / 256
#: ... and above so many rows; fewer are no burden to the task that gets them.
HOT_ROWS = 20_000
#: Rows of a counted table that are broadcast at most, some 100 bytes each.
BROADCAST_ROWS = 400_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, total: int | None = None, least: int = HOT_ROWS) -> list:
    """The keys that hold more than ``share`` of the rows and more than ``least``; by counting, fewer than 1 / share values."""
    total = df.count() if total is None else total
    if total <= least:
        return []
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = counts.where((F.col("n") > F.lit(max(total * share, least))) & F.col(key).isNotNull())
    return [row[0] for row in found.select(key).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row a key, on a key whose ``hot`` values are known.

    The rows of hot keys meet a broadcast of at most ``len(hot)`` rows and aren't shuffled; the others are joined as
    Spark sees fit.  ``how`` is inner, left, left_semi or left_anti.  Null keys match nothing.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int, most: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has ``rows`` rows (counted before), at most one a key.

    Up to ``most`` rows are broadcast and ``left`` stays where it is; more of them meet it by ``skew_join``.
    """
    if rows <= most:
        return left.join(F.broadcast(right), key, how)
    return skew_join(left, right, key, hot_keys(left, key), how)


def running_sum(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of ``keys`` before this one, in the order of chunk, then ``order``.

    ``chunk`` is a column that doesn't fall along ``order`` and holds a bounded number of rows of a key in each of its
    values.  Sums by chunk are added up first, one row a chunk; then each chunk is worked through alone, so no task holds
    all rows of a key.
    """
    whole = df.withColumn("_value", value)
    sums = whole.groupBy(*keys, chunk).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = whole.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return placed.join(bases, [*keys, chunk]).withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner", "_value")
