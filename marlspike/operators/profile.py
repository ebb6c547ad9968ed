"""Profiles of numeric columns, class by class, and scores of compared pairs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["count", "mean", "stddev", "min", "max"]


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: field, count, mean, stddev (sample), min and max as doubles; a single pass, no unpivot of rows."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    functions = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    whole = df.agg(*(functions[m](F.col(c)).cast("double").alias(f"{m}_{i}") for i, c in enumerate(columns) for m in METRICS))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), *(F.col(f"{m}_{i}").alias(m) for m in METRICS)) for i, c in enumerate(columns))))
    return whole.select(rows.alias("row")).select("row.*")


def long_form(summary: DataFrame, key: str, columns: list[str], names: tuple[str, str] = ("field", "value")) -> DataFrame:
    """(key, field, value as double): one row per cell of a table of text or numbers."""
    cells = summary.select(key, *(F.col(c).cast("string").try_cast("double").alias(c) for c in columns))
    return cells.unpivot([key], columns, *names)


def transposed(summary: DataFrame, key: str, columns: list[str], metrics: list[str]) -> DataFrame:
    """The summary with a row per column and a column per metric."""
    return long_form(summary, key, columns).groupBy("field").pivot(key, metrics).agg(F.first("value"))


def profile_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """(field, total, delta) of two profiles: counts added, means subtracted; the greatest difference first."""
    a, b = first.alias("a"), second.alias("b")
    joined = a.join(b, "field").select("field", (F.col("a.count") + F.col("b.count")).alias("total"), (F.col("a.mean") - F.col("b.mean")).alias("delta"))
    return joined.orderBy(F.desc("delta"), F.desc("total"))


def score(columns: list[str]) -> Column:
    """The sum of the columns, a missing one counting 0."""
    return reduce(add, (F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in columns))


def crosstab(df: DataFrame, above: Column, outcome: str, values: list) -> DataFrame:
    """(above, one count per value of the outcome); cells without rows are null."""
    return df.select(above.alias("above"), F.col(outcome)).groupBy("above").pivot(outcome, values).count()


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """(column, count), the most frequent first."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column)


def count_of_counts(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """(cnt, dist): how many values occur so often; the ``most`` most common counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt")).groupBy("cnt").agg(F.count(F.lit(1)).alias("dist")).orderBy(F.desc("dist"), "cnt").limit(most)
