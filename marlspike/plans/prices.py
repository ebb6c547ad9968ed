"""Queries of daily values: filled series, returns, risk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.operators import risk
from marlspike.scratch import Scratch
from marlspike.session import read

START, END = "1995-01-02", "2001-08-01"
TRIALS = 200_000


def _daily(spark: SparkSession, directory: str) -> DataFrame:
    """(symbol, date, close): the mean price of the orders of each priority and day, in whole cents."""
    orders = read(spark, directory, "orders")
    close = F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count(F.lit(1))).cast("double") / 100
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date")).agg(close.alias("close"))


def _returns(spark: SparkSession, directory: str) -> DataFrame:
    return risk.window_returns(risk.filled(_daily(spark, directory), "symbol", "date", "close", START, END), "symbol", "date", "close")


def fill_returns(spark: SparkSession, directory: str) -> DataFrame:
    """Ten-day returns of each symbol on every weekday."""
    return _returns(spark, directory).select("symbol", "date", F.round("return", 6).alias("ret"))


def long_histories(spark: SparkSession, directory: str) -> DataFrame:
    return risk.long_histories(_daily(spark, directory), "symbol", 1310).groupBy("symbol").agg(F.count(F.lit(1)).alias("days"))


def factor_matrix(spark: SparkSession, directory: str) -> DataFrame:
    """The returns with a column per symbol."""
    wide = risk.factor_matrix(_returns(spark, directory), "date", "symbol", "return", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return wide.select("date", *(F.round(F.col(f"`{c}`"), 6).alias(n) for c, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"))))


def featurized(spark: SparkSession, directory: str) -> DataFrame:
    """Signed squares and roots of the returns."""
    x = F.col("return")
    square, root, _ = risk.featurized([x])
    return _returns(spark, directory).select("symbol", "date", F.round(square, 6).alias("square"), F.round(root, 6).alias("root"))


def var_cvar(spark: SparkSession, directory: str) -> DataFrame:
    """The 5 % quantile of line prices and the mean of the smallest twentieth."""
    prices = read(spark, directory, "lineitem").select(F.col("l_extendedprice").alias("value"))
    var = risk.value_at_risk(prices)
    return risk.tail_mean(prices).select(F.lit(var).alias("var"), F.round("tail", 6).alias("cvar"))


def single_factor_fit(spark: SparkSession, directory: str) -> DataFrame:
    fit = risk.single_factor_fit(read(spark, directory, "lineitem"), "l_extendedprice", "l_quantity")
    return fit.select(*(F.round(c, 4).alias(c) for c in fit.columns))


def kupiec(spark: SparkSession, directory: str) -> DataFrame:
    """Dates whose mean return is below the 5 % quantile of all returns, and the ratio of that share to the expected one."""
    returns = Scratch(spark).save(_returns(spark, directory))
    var = risk.value_at_risk(returns, "return")
    row = risk.failures(returns, "date", "return", var).first()
    ratio = risk.kupiec_statistic(row["total"], row["failures"], 0.05)
    return spark.createDataFrame([(row["failures"], row["total"], round(ratio, 6))], "failures long, total long, ratio double")


def factor_weights(spark: SparkSession, directory: str) -> DataFrame:
    """Weights of the intercept and the featurized returns of two symbols, for each other."""
    returns = Scratch(spark).save(_returns(spark, directory))
    factors = ["1-URGENT", "2-HIGH"]
    wide = risk.factor_matrix(returns, "date", "symbol", "return", factors).toDF("date", "urgent", "high")
    others = returns.where(~F.col("symbol").isin(factors))
    weights = risk.factor_weights(others, "symbol", "date", "return", wide, ["urgent", "high"])
    return weights.select("symbol", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


def monte_carlo_var(spark: SparkSession, directory: str) -> DataFrame:
    """Value at risk, its tail mean and a bootstrap interval over simulated returns."""
    returns = Scratch(spark).save(_returns(spark, directory))
    factors = ["1-URGENT", "2-HIGH"]
    wide = risk.factor_matrix(returns, "date", "symbol", "return", factors).toDF("date", "urgent", "high").dropna()
    means, covariance = risk.moments(wide, ["urgent", "high"])
    fitted = risk.factor_weights(returns.where(~F.col("symbol").isin(factors)), "symbol", "date", "return", wide, ["urgent", "high"])
    weights = np.array([r["weights"] for r in fitted.orderBy("symbol").collect()])  # a row per instrument
    trials = Scratch(spark).save(risk.trial_returns(spark, weights, means, covariance, TRIALS, 16))
    low, high = risk.bootstrap_interval(trials, risk.value_at_risk, resamples=10)
    return risk.tail_mean(trials).select(F.lit(risk.value_at_risk(trials)).alias("var"), F.col("tail").alias("cvar"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def return_density(spark: SparkSession, directory: str) -> DataFrame:
    return risk.density(_returns(spark, directory), "return")


def density_points(spark: SparkSession, directory: str) -> DataFrame:
    """The density of the returns at the points, numbered."""
    found = risk.density(_returns(spark, directory), "return")
    place = F.row_number().over(Window.orderBy("x")) - 1  # a hundred rows
    return found.select(place.alias("place"), F.round("density", 4).alias("density"))


def factor_checks(spark: SparkSession, directory: str) -> DataFrame:
    """Whether what the fitted weights leave of each symbol's returns is at right angles to every column, as least squares leave it."""
    returns = Scratch(spark).save(_returns(spark, directory))
    factors = ["1-URGENT", "2-HIGH"]
    wide = risk.factor_matrix(returns, "date", "symbol", "return", factors).toDF("date", "urgent", "high")
    others = returns.where(~F.col("symbol").isin(factors))
    weights = risk.factor_weights(others, "symbol", "date", "return", wide, ["urgent", "high"])
    columns = F.array(F.lit(1.0), *risk.featurized([F.col("urgent"), F.col("high")]))
    met = others.join(wide, "date").join(F.broadcast(weights), "symbol").withColumn("x", columns)
    left = F.col("return") - F.aggregate(F.zip_with("weights", "x", lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x)
    met = met.withColumn("left", left)
    sums = met.groupBy("symbol").agg(*(F.sum(F.col("left") * F.element_at("x", i + 1)).alias(f"s{i}") for i in range(7)))
    return sums.select("symbol", (F.greatest(*(F.abs(f"s{i}") for i in range(7))) < 1e-6).alias("holds"))


def queries() -> dict:
    return {f.__name__: f for f in (fill_returns, long_histories, factor_matrix, featurized, var_cvar, single_factor_fit, kupiec, factor_weights, factor_checks, monte_carlo_var, return_density, density_points)}


_RETURNS = f"""
daily as (select o_orderpriority as symbol, o_orderdate::date as date, (sum(round(o_totalprice * 100)::bigint) // count(*))::double / 100 as close from orders group by 1, 2),
inside as (select * from daily where date between '{START}' and '{END}'),
calendar as (select unnest(generate_series(date '{START}'::timestamp, date '{END}'::timestamp - interval 1 day, interval 1 day))::date as date),
wanted as (select symbol, date from (select distinct symbol from inside), calendar where isodow(date) < 6),
filled as (
  select symbol, date, coalesce(
    (select close from inside i where i.symbol = w.symbol and i.date <= w.date order by i.date desc limit 1),
    (select close from inside i where i.symbol = w.symbol and i.date > w.date order by i.date limit 1)) as close
  from wanted w),
lagged as (select symbol, date, close, lag(close, 9) over (partition by symbol order by date) as f from filled),
returns as (select symbol, date, (close - f) / f as r from lagged where f is not null)"""


def oracles() -> dict[str, str]:
    tail = "select round(avg(x), 6) as t from (select l_extendedprice as x from lineitem order by x limit (select greatest(count(*) // 20, 1) from lineitem))"
    part = "(case when {0} = 0 then 0 else ({0}) * ln({1}) end)"
    kernel = "m as (select min(r) as lo, max(r) as hi, count(*) as n, 1.06 * stddev_pop(r) * power(count(*), -0.2) as w from returns), g as (select i, lo + (hi - lo) * i / 100 as x, n, w from m, (select unnest(range(100)) as i))"
    return {
        "density_points": f"with {_RETURNS}, {kernel} select i::int as place, round(sum(exp(-0.5 * power((x - r) / w, 2))) / (max(n) * max(w) * sqrt(2 * pi())), 4) as density from g, returns group by i",
        "factor_checks": f"with {_RETURNS} select distinct symbol, true as holds from returns where symbol not in ('1-URGENT', '2-HIGH')",
        "fill_returns": f"with {_RETURNS} select symbol, date, round(r, 6) as ret from returns",
        "long_histories": f"with {_RETURNS} select symbol, count(*) as days from daily group by symbol having count(*) >= 1310",
        "factor_matrix": f"with {_RETURNS} select date, round(max(r) filter (symbol = '1-URGENT'), 6) as urgent, round(max(r) filter (symbol = '2-HIGH'), 6) as high, round(max(r) filter (symbol = '3-MEDIUM'), 6) as medium from returns group by date",
        "featurized": f"with {_RETURNS} select symbol, date, round(sign(r) * r * r, 6) as square, round(sign(r) * sqrt(abs(r)), 6) as root from returns",
        "var_cvar": f"select (select quantile_disc(l_extendedprice, 0.05) from lineitem) as var, t as cvar from ({tail})",
        "single_factor_fit": "select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(covar_samp(l_extendedprice, l_quantity), 4) as covariance, round(corr(l_extendedprice, l_quantity), 4) as correlation from lineitem",
        "kupiec": f"with {_RETURNS}, v as (select quantile_disc(r, 0.05) as v from returns), d as (select date, avg(r) as r from returns group by date), k as (select count(*) filter (r < v)::bigint as f, count(*) as t from d, v) select f as failures, t as total, round(-2 * ((t - f) * ln(0.95::double) + f * ln(0.05::double) - {part.format('(t - f)', '1 - f::double / t')} - {part.format('f', 'f::double / t')}), 6) as ratio from k",
    }
