"""How names are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\u00a0"


def trimmed(column: Column | str) -> Column:
    """Without outer blanks; empty names become null."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.btrim(column, F.lit(BLANKS))
    return F.when(text != "", text)


def lower_name(column: Column | str) -> Column:
    return F.lower(trimmed(column))


def upper_name(column: Column | str) -> Column:
    return F.upper(trimmed(column))
