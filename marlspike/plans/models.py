"""Queries that fit models.  SQL can't fit them, but it can tell what a check of a fitted model must find."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.names import lower_name
from marlspike.operators import classify, cluster, ranking, sampling
from marlspike.plans.shops import _bought
from marlspike.scratch import Scratch
from marlspike.session import read

NUMBERS = ["duration", "src_bytes", "dst_bytes", "count", "srv_count", "serror_rate", "same_srv_rate"]
CATEGORIES = ["protocol_type", "flag"]


def _once(spark: SparkSession, directory: str, columns: list[str]) -> DataFrame:
    """Each connection once: of rows with the same id, the least by ``columns``."""
    rows = read(spark, directory, "kddcup").where("conn_id is not null").groupBy("conn_id").agg(F.min(F.struct(*columns)).alias("row"))
    return rows.select("conn_id", "row.*")


def _connections(spark: SparkSession, directory: str) -> DataFrame:
    rows = _once(spark, directory, [*NUMBERS, *CATEGORIES, "label"]).dropna(subset=NUMBERS)
    for c in NUMBERS:
        rows = rows.where(F.col(c) >= 0)
    return Scratch(spark).save(rows.select("conn_id", *NUMBERS, *(F.coalesce(lower_name(c), F.lit("unknown")).alias(c) for c in CATEGORIES), lower_name("label").alias("label")))


def _logins(spark: SparkSession, directory: str) -> DataFrame:
    rows = _once(spark, directory, [*NUMBERS, "logged_in"]).withColumn("label", F.col("logged_in").cast("double")).drop("logged_in")
    return Scratch(spark).save(rows.dropna().where("label in (0, 1)"))


def als_topn(spark: SparkSession, directory: str) -> DataFrame:
    """Five suppliers for each customer by latent factors."""
    bought = Scratch(spark).save(_bought(spark, directory).select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("n").cast("float")))
    model = ranking.factors(bought, "user", "item", "n")
    return ranking.recommend(model, bought.select("user").distinct(), 5)


def kmeans_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """Sizes of twelve clusters of connections over scaled and one-hot coded columns."""
    rows = _connections(spark, directory)
    model = cluster.clustering(rows, NUMBERS, CATEGORIES, k=12)
    return model.transform(rows).groupBy("cluster").count()


def kmeans_entropy(spark: SparkSession, directory: str) -> DataFrame:
    """How mixed the labels are in those clusters, by the number of clusters."""
    rows = _connections(spark, directory).where("label is not null")
    found = [cluster.label_entropy(cluster.clustering(rows, NUMBERS, k=k).transform(rows), "cluster", "label").withColumn("k", F.lit(k)) for k in (5, 20)]
    return found[0].unionByName(found[1])


def kmeans_anomalies(spark: SparkSession, directory: str) -> DataFrame:
    rows = _connections(spark, directory)
    model = cluster.clustering(rows, NUMBERS, k=12)
    return cluster.anomalies(cluster.model_distances(model, rows), 100).select("conn_id", "distance")


def vector_projection(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors by cluster in three random directions."""
    vectors = read(spark, directory, "embeddings")
    _, found = cluster.array_clustering(vectors, "embedding", 10)
    return cluster.random_projection(found, "embedding", 3, 64).select("vec_id", "cluster", "x0", "x1", "x2")


def forest_accuracy(spark: SparkSession, directory: str) -> DataFrame:
    """A forest that tells logged-in connections, on rows it hasn't seen."""
    rows = _logins(spark, directory)
    train, test = rows.where("conn_id % 10 < 9").drop("conn_id"), rows.where("conn_id % 10 >= 9").drop("conn_id")
    model = classify.tuned_forest(train, "label", gains=(0.0,), trees=(5,), depth=8, bins=64)
    return classify.scores(model.transform(test), "label", "prediction")


def tree_importances(spark: SparkSession, directory: str) -> DataFrame:
    rows = _logins(spark, directory).drop("conn_id")
    return spark.createDataFrame([(name, weight) for weight, name in classify.importances(classify.tree(rows, "label"))], "column string, importance double")


def kmeans_checks(spark: SparkSession, directory: str) -> DataFrame:
    """How many connections were clustered, and how many aren't in the cluster whose centre is nearest."""
    rows = _connections(spark, directory)
    model = cluster.clustering(rows, NUMBERS, k=12)
    means = model.stages[-1]
    vector = vector_to_array(means.getFeaturesCol())
    least = F.least(*(cluster.squared_distance(vector, F.array(*map(F.lit, map(float, c)))) for c in means.clusterCenters()))
    checked = cluster.model_distances(model, rows).select(((F.col("distance") - least) > 1e-6 * (1 + least)).alias("wrong"))
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("wrong"))


def kmeans_sweep(spark: SparkSession, directory: str) -> DataFrame:
    """The costs of growing numbers of clusters, over plain and over scaled columns."""
    rows = _connections(spark, directory)
    found = [(scale, k, cost) for scale in (False, True) for k, cost in cluster.sweep(rows, NUMBERS, (20, 60, 100), scale=scale)]
    return spark.createDataFrame(found, "scaled boolean, k int, cost double")


def _rated(spark: SparkSession, directory: str) -> DataFrame:
    return Scratch(spark).save(_bought(spark, directory).select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("n").cast("float")))


def als_checks(spark: SparkSession, directory: str) -> DataFrame:
    """How many users got suggestions, how many in all, and how many scores aren't the product of the factors."""
    bought = _rated(spark, directory)
    model = ranking.factors(bought, "user", "item", "n")
    best = ranking.recommend(model, bought.select("user").distinct(), 5)
    met = best.join(model.userFactors.toDF("user", "uf"), "user").join(model.itemFactors.toDF("item", "vf"), "item")
    dot = F.aggregate(F.zip_with("uf", "vf", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return met.agg(F.countDistinct("user").alias("users"), F.count(F.lit(1)).alias("n"), F.count_if(F.abs(dot - F.col("prediction")) > 1e-4).alias("wrong"))


def als_auc(spark: SparkSession, directory: str) -> DataFrame:
    """Factors fitted to nine tenths of the purchases, by the mean area under the curve of the other tenth, over a grid."""
    bought = _rated(spark, directory).withColumn("pair", F.concat_ws(":", "user", "item"))
    train, held = (part.drop("pair") for part in sampling.split(bought, "pair", [0.9, 0.1], 5))
    held = Scratch(spark).save(held)
    items = train.select("item").distinct()
    others = Scratch(spark).save(ranking.negatives(held, "user", "item", items))

    def area(model) -> float:
        def predict(pairs: DataFrame) -> DataFrame:
            return model.transform(pairs.select("user", "item")).select("user", "item", F.col("prediction").cast("double").alias("prediction"))

        return ranking.mean_auc(held, others, predict, "user").first()[0]

    found = ranking.factor_grid(Scratch(spark).save(train), "user", "item", "n", area, ranks=(5, 30), regs=(1.0,), alphas=(1.0, 40.0), rounds=5)
    return spark.createDataFrame([(rank, reg, alpha, auc) for auc, (rank, reg, alpha) in found], "rank int, reg double, alpha double, auc double")


def tree_accuracy(spark: SparkSession, directory: str) -> DataFrame:
    """The best tree of the whole grid, on the tenth of the connections that it hasn't seen."""
    train, test = sampling.split(_logins(spark, directory), "conn_id", [0.9, 0.1], 2)
    model = classify.tuned_tree(Scratch(spark).save(train.drop("conn_id")), "label")
    return classify.scores(model.transform(test.drop("conn_id")), "label", "prediction")


_QUERIES = (als_topn, als_checks, als_auc, kmeans_sizes, kmeans_checks, kmeans_sweep, kmeans_entropy, kmeans_anomalies, vector_projection, forest_accuracy, tree_accuracy, tree_importances)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracles() -> dict[str, str]:
    usable = " and ".join(f"{c} >= 0" for c in NUMBERS)
    users = "select count(distinct o_custkey) as users from orders join lineitem on l_orderkey = o_orderkey"
    return {
        "kmeans_checks": f"select count(distinct conn_id) as n, 0::bigint as wrong from kddcup where conn_id is not null and {usable}",
        "als_checks": f"select users, users * least(5, (select count(distinct l_suppkey) from lineitem)) as n, 0::bigint as wrong from ({users})",
    }
