"""Classifiers of candidate pairs with pyspark.ml: logistic regression, boosted trees, blends, and their choice.

The gradient-boosted learners are Spark's; their metrics are their own and nobody else's.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLENDS = (0.25, 0.5, 0.75)


def _columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c.startswith("f_")]


def logistic(matrix: DataFrame, c: float = 1.0, iterations: int = 500) -> PipelineModel:
    """Standardised features; the penalty is 1 / (c * rows), so that c means what it does in other libraries."""
    n = max(1, matrix.count())
    stages = [VectorAssembler(inputCols=_columns(matrix), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="label", maxIter=iterations, regParam=1 / (c * n))]
    return Pipeline(stages=stages).fit(matrix)


def boosted(matrix: DataFrame, rounds: int = 40, depth: int = 5, step: float = 0.1, subsample: float = 0.8, seed: int = 42) -> PipelineModel:
    stages = [VectorAssembler(inputCols=_columns(matrix), outputCol="features"), GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed)]
    return Pipeline(stages=stages).fit(matrix)


def forest(matrix: DataFrame, trees: int = 60, depth: int = 7, seed: int = 42) -> PipelineModel:
    stages = [VectorAssembler(inputCols=_columns(matrix), outputCol="features"), RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(matrix)


def predict(model: PipelineModel, matrix: DataFrame, name: str = "probability") -> DataFrame:
    """matrix without its features and with the probability of a link."""
    scored = model.transform(matrix).withColumn("_p", vector_to_array("probability")[1])
    rest = [c for c in matrix.columns if not c.startswith("f_")]
    return scored.select(*rest, F.col("_p").alias(name))


def blend(one: DataFrame, other: DataFrame, share: float) -> DataFrame:
    """`share` of the first probability and the rest of the second, by pair."""
    b = other.select("s1_id", "target_id", F.col("probability").alias("_q"))
    return one.join(b, ["s1_id", "target_id"]).withColumn("probability", share * F.col("probability") + (1 - share) * F.col("_q")).drop("_q")


def importances(model: PipelineModel, names: list[str], n: int = 10) -> list[tuple[str, float]]:
    """The n most important features of a tree model, or the largest coefficients of a linear one."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def curves(scored: DataFrame) -> dict[str, float]:
    """Areas under the ROC and precision-recall curves. scored: probability, label."""
    s = scored.select(F.col("probability").cast("double").alias("p"), F.col("label").cast("double").alias("label"))
    of = lambda m: BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", metricName=m).evaluate(s)
    return {"roc_auc": of("areaUnderROC"), "pr_auc": of("areaUnderPR")}


def winner(scores: dict[str, float], preferred: str | None = None) -> str:
    """The name of the highest score; ties go to `preferred`, else to the first name."""
    best = max(scores.values())
    tied = [k for k, v in scores.items() if v == best]
    return preferred if preferred in tied else sorted(tied)[0]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
