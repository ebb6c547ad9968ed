"""Samples and splits by a hash of a key, so that a task run again, or any other engine, draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes are whole numbers below this.
SPAN = 1 << 32


def draw(key: str, seed: int) -> Column:
    """A number from 0 to SPAN - 1 for each key: the first eight digits of the MD5 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bernoulli(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """Rows of about ``share`` of the keys; rows of one key come all or not at all, those of a null key too."""
    return df.where(draw(key, seed) < int(share * SPAN))


def split(df: DataFrame, key: str, weights: list[float], seed: int = 1) -> list[DataFrame]:
    """Parts that have every row once, of sizes as the weights; rows of one key are in one part."""
    cuts = [int(sum(weights[:i]) / sum(weights) * SPAN) for i in range(len(weights))] + [SPAN]
    return [df.where((draw(key, seed) >= low) & (draw(key, seed) < high)) for low, high in zip(cuts, cuts[1:])]


def take(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows, or all if there are fewer: the first by hash, then key; each task keeps its own first n before they meet."""
    return df.orderBy(draw(key, seed), key).limit(n)
