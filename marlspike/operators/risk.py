"""Histories of prices, factor models, simulated returns and value at risk."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.numeric import chi_squared_tail, featurized


def weekdays(start: str, end: str) -> Column:
    """Mondays to Fridays from ``start`` up to, without, ``end``, as an array of dates."""
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def filled(prices: DataFrame, symbol: str, date: str, value: str, start: str, end: str) -> DataFrame:
    """(symbol, date, value) on every weekday of the range: the last value up to then, before the first one that first value."""
    inside = prices.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(symbol, F.col(date).cast("date").alias("date"), value)
    calendar = inside.select(symbol).distinct().withColumn("date", F.explode(weekdays(start, end)))
    # values of days off the calendar count for the days after, so both sides are one sequence
    marked = calendar.select(symbol, "date", F.lit(None).cast(prices.schema[value].dataType).alias(value), F.lit(1).alias("_wanted")).unionByName(inside.withColumn("_wanted", F.lit(0)))
    order = Window.partitionBy(symbol).orderBy("date", "_wanted")
    last = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # of days before it
    return marked.withColumn("_filled", F.coalesce(last, first)).where("_wanted = 1").select(symbol, "date", F.col("_filled").alias(value))


def window_returns(series: DataFrame, symbol: str, date: str, value: str, days: int = 10) -> DataFrame:
    """(symbol, date, return): the relative change over each window of ``days`` rows, dated by its last."""
    first = F.lag(value, days - 1).over(Window.partitionBy(symbol).orderBy(date))
    change = F.try_divide(F.col(value) - first, first)
    return series.select(symbol, date, change.alias("return"), first.isNotNull().alias("_full")).where("_full").drop("_full")


def long_histories(prices: DataFrame, symbol: str, least: int = 1310) -> DataFrame:
    """Rows of symbols with at least ``least`` of them."""
    enough = prices.groupBy(symbol).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(symbol)
    return prices.join(enough, symbol, "left_semi")


def factor_matrix(returns: DataFrame, date: str, factor: str, value: str, factors: list[str]) -> DataFrame:
    """(date, a column per factor)."""
    return returns.groupBy(date).pivot(factor, factors).agg(F.first(value))


def factor_weights(returns: DataFrame, symbol: str, date: str, value: str, matrix: DataFrame, factors: list[str]) -> DataFrame:
    """(symbol, weights): least-squares weights of the intercept and the featurized factors, one fit a symbol."""
    wide = matrix.select(date, F.array(F.lit(1.0), *featurized([F.col(f).cast("double") for f in factors])).alias("_x"))
    rows = returns.join(wide, date).select(symbol, F.col(value).cast("double").alias("_y"), "_x").where("_y is not null")
    kind = returns.schema[symbol].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        weights, *_ = np.linalg.lstsq(np.vstack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(), rcond=None)
        return pd.DataFrame({symbol: [pdf[symbol].iloc[0]], "weights": [weights]})

    return rows.groupBy(symbol).applyInPandas(fit, f"`{symbol}` {kind}, weights array<double>")


def single_factor_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept, covariance, correlation) of one regressor."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.covar_samp(y, x).alias("covariance"), F.corr(y, x).alias("correlation"))


def moments(matrix: DataFrame, factors: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The means and the sample covariances of the factors, in one pass."""
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i:]]
    row = matrix.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(factors)), *(F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    covariance = np.zeros((len(factors), len(factors)))
    for i, (a, b) in enumerate(pairs):
        p, q = factors.index(a), factors.index(b)
        covariance[p, q] = covariance[q, p] = row[f"c{i}"]
    return np.array([row[f"m{i}"] for i in range(len(factors))]), covariance


def trial_returns(spark, weights: np.ndarray, means: np.ndarray, covariance: np.ndarray, trials: int = 10_000_000, tasks: int = 1000, seed: int = 1001) -> DataFrame:
    """(value): the mean return over instruments of each simulated draw of the factors; each task has a seed of its own.

    ``weights`` has a row per instrument, as ``factor_weights`` gives them; the mean over instruments is linear in them,
    so that a trial costs one product whatever the number of instruments.
    """
    mean_weights = np.asarray(weights, dtype=float).mean(axis=0)
    each = -(-trials // tasks)

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base in batch["id"]:
                draw = np.random.default_rng(int(base))
                left = min(each, trials - (int(base) - seed) * each)
                while left > 0:
                    n = min(left, 100_000)
                    f = draw.multivariate_normal(means, covariance, n)
                    x = np.hstack([np.sign(f) * f * f, np.sign(f) * np.sqrt(np.abs(f)), f])
                    yield pd.DataFrame({"value": mean_weights[0] + x @ mean_weights[1:]})
                    left -= n

    return spark.range(seed, seed + tasks, 1, tasks).mapInPandas(simulate, "value double")


#: Equal intervals that one pass counts, and the rows that are few enough to be sorted in one task.
BINS = 4096
FEW_ROWS = 100_000


def _signed_log(v: Column) -> Column:
    """Grows with v; the offset keeps logarithms of the least doubles above 0."""
    return F.signum(v) * F.coalesce(F.log2(F.abs(v)) + 1100, F.lit(0.0))


def smallest(df: DataFrame, value: str, rank: Callable[[int], int]) -> tuple[float, int, float, int] | None:
    """The k-th smallest of n values for k = rank(n), the number of values below it, their sum, and k; null and NaN are no values.

    Each pass counts the values of BINS intervals between bounds, on the map side, and goes on in the interval that holds
    the rank, whose least and greatest value are the next bounds; at most BINS rows come to the driver.  Intervals are equal
    by logarithm and by value in turns, so that a few passes do for any spread.  The few values left at the end are sorted;
    nothing else is, and no task holds a share of all rows.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where("v is not null and not isnan(v)")
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not n:
        return None
    k, below, total = min(max(rank(n), 1), n), 0, 0.0
    for turn in itertools.count():
        if low == high or n <= FEW_ROWS:
            break
        inside = rows.where(F.col("v").between(F.lit(low), F.lit(high)))
        at, start, end = (_signed_log(F.col("v")), _signed_log(F.lit(low)), _signed_log(F.lit(high))) if turn % 2 == 0 else (F.col("v") / 2, F.lit(low / 2), F.lit(high / 2))
        place = F.coalesce(F.try_divide(at - start, end - start), F.lit(0.0))
        bins = inside.groupBy(F.least(F.floor(place * BINS), F.lit(BINS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for row in sorted(bins.collect()):
            if below + row["n"] >= k:
                low, high, n = row["lo"], row["hi"], row["n"]
                break
            below, total = below + row["n"], total + row["s"]
    if low < high:
        left = np.sort(rows.where(F.col("v").between(F.lit(low), F.lit(high))).toPandas()["v"].to_numpy())
        low = float(left[k - below - 1])
        total, below = total + float(left[left < low].sum()), below + int((left < low).sum())
    return low, below, total, k


def value_at_risk(returns: DataFrame, value: str = "value", share: float = 0.05) -> float | None:
    """The exact quantile: a value of the data, not between two; None without rows."""
    found = smallest(returns, value, lambda n: math.ceil(n * share))
    return found and found[0]


def tail_mean(returns: DataFrame, value: str = "value", share: float = 0.05) -> DataFrame:
    """(tail): the mean of the smallest n * share values, of one at least; of equal values at the end, so many as count."""
    found = smallest(returns, value, lambda n: int(n * share))
    tail = (found[2] + (found[3] - found[1]) * found[0]) / found[3] if found else None
    return returns.sparkSession.createDataFrame([(tail,)], "tail double")


def bootstrap_interval(trials: DataFrame, statistic: Callable[[DataFrame], float], resamples: int = 100, p: float = 0.05, seed: int = 1) -> tuple[float, float]:
    """The interval of a statistic over samples drawn with replacement."""
    found = sorted(statistic(trials.sample(True, 1.0, seed + i)) for i in range(resamples))
    low, high = interval_places(resamples, p)
    return found[low], found[high]


def interval_places(resamples: int, p: float) -> tuple[int, int]:
    return max(0, math.floor(resamples * p / 2 - 1)), min(resamples - 1, math.ceil(resamples * (1 - p / 2)))


def failures(returns: DataFrame, date: str, value: str, risk: float | Column, how: str = "mean") -> DataFrame:
    """(failures, total): dates on which the mean (or sum) over instruments is below the value at risk."""
    daily = returns.groupBy(date).agg((F.avg(value) if how == "mean" else F.sum(value)).alias("r"))
    return daily.agg(F.coalesce(F.sum(F.when(F.col("r") < risk, 1).otherwise(0)), F.lit(0)).alias("failures"), F.count(F.lit(1)).alias("total"))


def kupiec_statistic(total: int, failed: int, confidence: float) -> float:
    """The proportion-of-failures ratio, with 0 * log(0) as 0."""

    def part(n: int, q: float) -> float:
        return n * math.log(q) if n else 0.0

    ratio = failed / total
    expected = part(total - failed, 1 - confidence) + part(failed, confidence)
    seen = part(total - failed, 1 - ratio) + part(failed, ratio)
    return -2 * (expected - seen)


def kupiec_p(total: int, failed: int, confidence: float) -> float:
    return chi_squared_tail(kupiec_statistic(total, failed, confidence))


def density(df: DataFrame, value: str, steps: int = 100) -> DataFrame:
    """(x, density): a Gaussian kernel estimate at ``steps`` points from the least to the greatest value; none without values.

    Each task adds up the kernels of its rows at every point, in Arrow batches, and sends one row a point.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    low, high, n, deviation = rows.agg(F.min("v"), F.max("v"), F.count("v"), F.stddev_pop("v")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = 1.06 * deviation * n**-0.2 or 1e-9
    at = np.array([low + (high - low) * i / steps for i in range(steps)])

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.zeros(len(at))
        for batch in batches:
            whole += np.exp(-0.5 * ((batch["v"].to_numpy()[:, None] - at) / width) ** 2).sum(axis=0)
        yield pd.DataFrame({"place": np.arange(len(at)), "x": at, "part": whole})

    parts = rows.mapInPandas(kernels, "place int, x double, part double").groupBy("place", "x").agg(F.sum("part").alias("part"))
    return parts.orderBy("place").select("x", (F.col("part") / (n * width * math.sqrt(2 * math.pi))).alias("density"))
