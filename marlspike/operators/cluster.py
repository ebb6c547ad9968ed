"""k-means, how pure its clusters are, and rows far from every centre."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of numbers of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def label_entropy(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(entropy): the entropy (natural logarithm) of the labels in each cluster, weighted by the cluster's rows."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy(cluster))  # over the labels of a cluster
    parts = counts.withColumn("size", size).groupBy(cluster).agg(F.first("size").alias("size"), F.sum(-F.col("n") / F.col("size") * F.log(F.col("n") / F.col("size"))).alias("h"))
    return parts.agg((F.sum(F.col("size") * F.col("h")) / F.sum("size")).alias("entropy"))


def clustering(df: DataFrame, numeric: list[str], categorical: list[str] = (), k: int = 10, scale: bool = True, rounds: int = 40, tolerance: float = 1e-5, seed: int = 1) -> PipelineModel:
    """k-means over the numeric columns and, one-hot coded, the categorical ones; scaled to unit deviation if wished."""
    stages = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_indexed", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}_indexed"], outputCols=[f"{c}_vec"])]
    stages.append(VectorAssembler(inputCols=[*numeric, *(f"{c}_vec" for c in categorical)], outputCol="assembled"))
    if scale:
        stages.append(StandardScaler(inputCol="assembled", outputCol="features", withStd=True, withMean=False))
    stages.append(KMeans(seed=seed, k=k, maxIter=rounds, tol=tolerance, initMode="k-means||", featuresCol="features" if scale else "assembled", predictionCol="cluster"))
    return Pipeline(stages=stages).fit(df)


def cost(model: PipelineModel) -> float:
    """The sum of squared distances to the nearest centre over the rows the model was fitted to."""
    return model.stages[-1].summary.trainingCost


def sweep(df: DataFrame, numeric: list[str], ks, **options) -> list[tuple[int, float]]:
    """(k, cost) of each number of clusters."""
    return [(k, cost(clustering(df, numeric, k=k, **options))) for k in ks]


def centre_distances(df: DataFrame, features: str, cluster: str, centres: DataFrame) -> DataFrame:
    """``df`` with ``distance``, the squared distance to its cluster's centre; ``centres`` has (cluster, centre array)."""
    return df.join(F.broadcast(centres), cluster).withColumn("distance", squared_distance(F.col(features), F.col("centre"))).drop("centre")


def model_distances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """As ``centre_distances`` for a model of ``clustering``."""
    means = model.stages[-1]
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(means.clusterCenters())], "cluster int, centre array<double>")
    return centre_distances(model.transform(df).withColumn("_array", vector_to_array(means.getFeaturesCol())), "_array", "cluster", centres).drop("_array")


def anomalies(distances: DataFrame, k: int = 100) -> DataFrame:
    """Rows at least as far as the k-th farthest, or as the nearest if there are fewer than k."""
    threshold = distances.select("distance").orderBy(F.desc("distance")).limit(k).agg(F.min("distance").alias("_threshold"))
    return distances.join(F.broadcast(threshold), F.col("distance") >= F.col("_threshold")).drop("_threshold")


def random_projection(df: DataFrame, features: str, dimensions: int = 3, length: int | None = None, seed: int = 1) -> DataFrame:
    """``df`` with ``x0 .. x{dimensions-1}``: dot products of an array column with random normal directions."""
    length = length or df.select(F.size(features)).first()[0]
    directions = np.random.default_rng(seed).standard_normal((dimensions, length)) / np.sqrt(length)
    dot = {f"x{i}": F.aggregate(F.zip_with(F.col(features), F.array(*map(F.lit, map(float, row))), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) for i, row in enumerate(directions)}
    return df.withColumns(dot)


def array_clustering(df: DataFrame, features: str, k: int, rounds: int = 20, seed: int = 1):
    """(model, df with cluster): k-means over an array column."""
    vectors = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    model = KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vectors)
    return model, model.transform(vectors).drop("_v")
