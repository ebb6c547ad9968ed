"""Recommendation by popularity or latent factors, and its quality as a mean area under the curve."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an alias table that are broadcast at most.
BROADCAST_ALIASES = 1_000_000


def canonical(counts: DataFrame, column: str, aliases: DataFrame, alias: str, target: str) -> DataFrame:
    """``counts`` with aliases of ``column`` replaced by their targets; ids without an alias stay.

    Of several targets of an alias the least counts.  The table is broadcast while it has at most BROADCAST_ALIASES rows.
    """
    one = aliases.where(F.col(alias).isNotNull()).groupBy(F.col(alias).alias("_alias")).agg(F.min(target).alias("_target"))
    side = F.broadcast(one) if one.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES else one
    joined = counts.join(side, F.col(column) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_target", column)).drop("_alias", "_target")


def item_totals(train: DataFrame, item: str, count: str) -> DataFrame:
    """(item, prediction): the total count of each item."""
    return train.groupBy(item).agg(F.sum(count).alias("prediction"))


def by_popularity(pairs: DataFrame, user: str, item: str, totals: DataFrame) -> DataFrame:
    """(user, item, prediction) of pairs, by totals that are there already; items never seen have none."""
    return pairs.select(user, item).join(totals, item, "left").select(user, item, "prediction")


def popularity(train: DataFrame, user: str, item: str, count: str, pairs: DataFrame) -> DataFrame:
    """(user, item, prediction): each pair with the item's total count; items never seen have none."""
    return by_popularity(pairs, user, item, item_totals(train, item, count))


def _hash(column: str) -> Column:
    """60 bits of the MD5 of a column's text, which any database can compute."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("long")


def negatives(positives: DataFrame, user: str, item: str, items: DataFrame) -> DataFrame:
    """(user, item): for each user as many items it has no row with as it has rows, or all there are; the first by a hash.

    A user with p positives finds its negatives among the 2p + 1 items that follow a point of the ring of all items, sorted
    by hash, drawn for the user; of those at most p are positives, so enough are left.  No user meets all items.
    """
    mine = positives.select(user, item).distinct()
    ring = items.select(item).distinct().withColumn("_hash", _hash(item))
    # places on the ring without one sort in one task: 4096 ranges by hash, their sizes added up
    ring = ring.withColumn("_range", F.shiftright("_hash", 48))
    sizes = ring.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ring.join(F.broadcast(starts), "_range").withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_hash", item)) - 1)
    total = items.select(item).distinct().count()
    wanted = mine.groupBy(user).agg(F.count(F.lit(1)).alias("_p")).withColumn("_from", F.pmod(_hash(user), F.lit(max(1, total))))
    steps = F.explode(F.sequence(F.lit(0), F.least(F.lit(2) * F.col("_p"), F.lit(total - 1)).cast("int"))).alias("_step")
    near = wanted.select(user, "_p", "_from", steps).withColumn("_place", F.pmod(F.col("_from") + F.col("_step"), F.lit(max(1, total))))
    candidates = near.join(placed.select(item, "_place"), "_place").join(mine, [user, item], "left_anti")
    ranked = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy(user).orderBy("_step")))
    return ranked.where("_rank <= _p").select(user, item)


def mean_auc(positives: DataFrame, negative: DataFrame, predict: Callable[[DataFrame], DataFrame], user: str) -> DataFrame:
    """(mean_auc): the mean over users of the share of pairs (positive, negative) in which the positive scores higher.

    ``predict`` makes (user, item, prediction) of pairs, for either kind.  Ties and missing predictions (null or NaN) count as wrong.  Pairs aren't made: per user and score, the negatives below a positive
    are counted by a running sum, which gives the same shares.
    """
    scored = predict(positives).withColumn("_positive", F.lit(1)).unionByName(predict(negative).withColumn("_positive", F.lit(0)))
    scored = scored.withColumn("prediction", F.when(~F.isnan(F.col("prediction").cast("double")), F.col("prediction")))
    at = scored.groupBy(user, "prediction").agg(F.sum("_positive").alias("_p"), F.sum(1 - F.col("_positive")).alias("_n"))
    below = F.coalesce(F.sum(F.when(F.col("prediction").isNotNull(), F.col("_n"))).over(Window.partitionBy(user).orderBy("prediction").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    right = at.withColumn("_right", F.when(F.col("prediction").isNotNull(), F.col("_p") * below).otherwise(0))
    users = right.groupBy(user).agg(F.sum("_right").alias("_right"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n")).where("_p > 0 and _n > 0")
    return users.agg(F.avg(F.col("_right") / (F.col("_p").cast("double") * F.col("_n"))).alias("mean_auc"))


def factors(train: DataFrame, user: str, item: str, count: str, rank: int = 10, reg: float = 0.01, alpha: float = 1.0, rounds: int = 5, seed: int = 1) -> ALSModel:
    """Implicit-feedback alternating least squares."""
    return ALS(implicitPrefs=True, rank=rank, regParam=reg, alpha=alpha, maxIter=rounds, seed=seed, userCol=user, itemCol=item, ratingCol=count, coldStartStrategy="nan").fit(train)


def factor_grid(train: DataFrame, user: str, item: str, count: str, evaluate: Callable[[ALSModel], float], ranks=(5, 30), regs=(1.0, 0.0001), alphas=(1.0, 40.0), rounds: int = 20) -> list[tuple[float, tuple]]:
    """(evaluation, (rank, reg, alpha)) of every combination, the best first."""
    grid = [(r, g, a) for r in ranks for g in regs for a in alphas]
    return sorted(((evaluate(factors(train, user, item, count, r, g, a, rounds)), (r, g, a)) for r, g, a in grid), reverse=True)


def recommend(model: ALSModel, users: DataFrame, most: int) -> DataFrame:
    """(user, item, prediction): the ``most`` best items of each of the given users."""
    user, item = model._java_obj.getUserCol(), model._java_obj.getItemCol()
    best = model.recommendForUserSubset(users, most)
    return best.select(user, F.explode("recommendations").alias("r")).select(user, F.col(f"r.{item}").alias(item), F.col("r.rating").cast("double").alias("prediction"))
