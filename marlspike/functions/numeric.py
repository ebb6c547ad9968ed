"""Scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_id(text: Column) -> Column:
    """The first eight bytes of the text's MD5 as a little-endian signed integer."""
    digest = F.md5(text.cast("string"))

    def byte(i: int) -> Column:
        return F.shiftleft(F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("long"), 8 * i)

    whole = byte(0)
    for i in range(1, 8):
        whole = whole.bitwiseOR(byte(i))
    return whole


def chi_squared(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Of a two by two table, with the continuity correction: records with both, with each, and all; null if a margin is 0."""
    both, first, second, total = (c.cast("double") for c in (both, first, second, total))
    neither = total - first - second + both
    apart = F.abs(both * neither - (first - both) * (second - both)) - total / 2
    return F.try_divide(total * apart * apart, first * (total - first) * second * (total - second))


def signed_square(x: Column) -> Column:
    return F.signum(x) * x * x


def signed_root(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def featurized(columns: list[Column]) -> list[Column]:
    """Signed squares, then signed roots, then the columns themselves."""
    return [*map(signed_square, columns), *map(signed_root, columns), *columns]


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours between two times in milliseconds, cut towards 0."""
    gap = end - start
    return F.when(gap >= 0, F.floor(gap / 3_600_000)).otherwise(-F.floor(-gap / 3_600_000)).cast("long")


def chi_squared_tail(x: float) -> float:
    """1 minus the distribution function of chi squared with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0
