"""Class priors, confusion matrices, scores, decision trees and forests."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplitModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.scratch import Scratch


def priors(df: DataFrame, label: str) -> DataFrame:
    """(label, prior): each class's share of the rows."""
    counts = df.groupBy(label).count()
    whole = F.sum("count").over(Window.partitionBy(F.lit(0)))  # over the classes, not the rows
    return counts.select(label, (F.col("count") / whole).alias("prior"))


def random_accuracy(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """(accuracy): that of guessing classes by the priors of the training rows; classes are matched by their label."""
    a, b = priors(train, label).withColumnRenamed("prior", "p"), priors(test, label).withColumnRenamed("prior", "q")
    return a.join(b, label).agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0.0)).alias("accuracy"))


def confusion(predictions: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """(label, one count per predicted class), 0 where there are no rows."""
    return predictions.groupBy(label).pivot(prediction, classes).count().fillna(0, [str(c) for c in classes]).orderBy(label)


def scores(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy, f1): f1 is that of each class weighted by its rows."""
    pairs = predictions.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    zero, n, kind = F.lit(0).cast("long"), F.col("n"), "double"
    # each pair counts for its label and for its prediction; one reading of the predictions, so a model runs once
    as_label = F.struct(F.col(label).cast(kind).alias("k"), n.alias("rows"), zero.alias("said"), F.when(F.col(label) == F.col(prediction), n).otherwise(zero).alias("hit"))
    as_said = F.struct(F.col(prediction).cast(kind).alias("k"), zero.alias("rows"), n.alias("said"), zero.alias("hit"))
    parts = pairs.select(F.explode(F.array(as_label, as_said)).alias("p")).select("p.*")
    each = parts.groupBy("k").agg(F.sum("rows").alias("rows"), F.sum("said").alias("said"), F.sum("hit").alias("hit")).where("rows > 0")
    return each.agg((F.sum("hit") / F.sum("rows")).alias("accuracy"), (F.sum(F.col("rows") * 2 * F.col("hit") / (F.col("rows") + F.col("said"))) / F.sum("rows")).alias("f1"))


def one_hot_index(columns: list[str]) -> Column:
    """Which of the columns is 1, from 0; -1 if none is."""
    return F.array_position(F.array(*(F.col(c).cast("int") for c in columns)), 1).cast("int") - 1


def decoded_one_hot(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Each group of 0/1 columns replaced by one column with the index of its 1."""
    return df.withColumns({name: one_hot_index(columns) for name, columns in groups.items()}).drop(*(c for columns in groups.values() for c in columns))


def assembled(df: DataFrame, label: str, output: str = "features") -> DataFrame:
    """All other columns, in their order, as one vector."""
    return VectorAssembler(inputCols=[c for c in df.columns if c != label], outputCol=output).transform(df)


def tree(df: DataFrame, label: str, seed: int = 1, **options) -> PipelineModel:
    """A decision tree over all other columns."""
    stages = [VectorAssembler(inputCols=[c for c in df.columns if c != label], outputCol="features"), DecisionTreeClassifier(seed=seed, labelCol=label, featuresCol="features", predictionCol="prediction", **options)]
    return Pipeline(stages=stages).fit(df)


def importances(model: PipelineModel) -> list[tuple[float, str]]:
    """(importance, column) of a model of ``tree`` or ``forest``, the most important first."""
    names = model.stages[0].getInputCols()
    return sorted(zip(model.stages[-1].featureImportances.toArray().tolist(), names, strict=True), reverse=True)


def tuned_tree(df: DataFrame, label: str, seed: int = 1, depths=(1, 20), bins=(40, 300), impurities=("gini", "entropy"), gains=(0.0, 0.05)) -> TrainValidationSplitModel:
    """The best tree of a grid, judged by accuracy on a tenth of the rows."""
    assembler = VectorAssembler(inputCols=[c for c in df.columns if c != label], outputCol="features")
    model = DecisionTreeClassifier(seed=seed, labelCol=label, featuresCol="features", predictionCol="prediction")
    grid = ParamGridBuilder().addGrid(model.impurity, list(impurities)).addGrid(model.maxDepth, list(depths)).addGrid(model.maxBins, list(bins)).addGrid(model.minInfoGain, list(gains)).build()
    return _best(Pipeline(stages=[assembler, model]), grid, df, label, seed)


def tuned_forest(df: DataFrame, label: str, seed: int = 1, gains=(0.0, 0.05), trees=(1, 10), categories: int = 40, bins: int = 300, depth: int = 20) -> TrainValidationSplitModel:
    """The best random forest of a grid over columns indexed as categories where they have few values."""
    assembler = VectorAssembler(inputCols=[c for c in df.columns if c != label], outputCol="features")
    indexer = VectorIndexer(maxCategories=categories, inputCol="features", outputCol="indexed", handleInvalid="keep")
    model = RandomForestClassifier(seed=seed, labelCol=label, featuresCol="indexed", predictionCol="prediction", impurity="entropy", maxDepth=depth, maxBins=bins)
    grid = ParamGridBuilder().addGrid(model.minInfoGain, list(gains)).addGrid(model.numTrees, list(trees)).build()
    return _best(Pipeline(stages=[assembler, indexer, model]), grid, df, label, seed)


def _best(pipeline: Pipeline, grid: list, df: DataFrame, label: str, seed: int) -> TrainValidationSplitModel:
    """The pipeline fitted to all rows with the parameters that do best on a tenth of them when fitted to the others.

    A forest keeps a summary of its training, and with it the session, which can't be sent to executors once the session
    has observed a query; so the summary goes before the model is used, which Spark's own search leaves no room for.
    """
    judge = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    train, held = (Scratch(df.sparkSession).save(part) for part in df.randomSplit([0.9, 0.1], seed))
    reached = [judge.evaluate(_sendable(pipeline.fit(train, options)).transform(held)) for options in grid]
    best = max(range(len(grid)), key=reached.__getitem__)
    return TrainValidationSplitModel(_sendable(pipeline.fit(df, grid[best])), reached)


def _sendable(model: PipelineModel) -> PipelineModel:
    stage = model.stages[-1]
    if getattr(stage, "hasSummary", False):
        stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model
