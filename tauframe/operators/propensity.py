"""Propensity scores: logistic, boosted trees and randomised search."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauframe.operators.sampling import share_of, stratified_folds
from tauframe.session import persist_sized
from tauframe.spec import CausalSpec

# The search space of the boosted propensity model.
SEARCH_SPACE = {
    "maxIter": [50, 100, 200],
    "maxDepth": [2, 3, 5, 8],
    "stepSize": [0.0001, 0.001, 0.01, 0.1, 0.2, 0.3],
    "subsamplingRate": [0.3, 0.5, 0.8, 1.0],
}


def assemble(df: DataFrame, spec: CausalSpec, keep=()) -> DataFrame:
    """Id, label and the covariate vector, nothing else."""
    wide = VectorAssembler(
        inputCols=list(spec.covariates), outputCol="features", handleInvalid="error"
    ).transform(df)
    return wide.select(
        spec.id, F.col(spec.treatment).cast("double").alias("label"), "features", *keep
    )


@dataclass
class PropensityModel:
    model: Model
    spec: CausalSpec
    details: dict = field(default_factory=dict)

    def score(self, df: DataFrame, name: str = "ps") -> DataFrame:
        """All rows and columns of ``df`` with P(treated)."""
        wide = VectorAssembler(
            inputCols=list(self.spec.covariates), outputCol="features", handleInvalid="error"
        ).transform(df)
        scored = self.model.transform(wide)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))

    def accuracy(self, df: DataFrame) -> float:
        scored = self.model.transform(assemble(df, self.spec))
        return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]

    def importances(self, spark) -> DataFrame:
        """(feature, importance) of a tree model, impurity-based and summing to one."""
        values = self.model.featureImportances.toArray().tolist()
        return spark.createDataFrame(
            list(zip(self.spec.covariates, values)), "feature string, importance double"
        )


def fit_logistic(train: DataFrame, spec: CausalSpec, strength: float = 1.0, max_iter: int = 1000):
    """L2-penalised logistic model; ``strength`` is the inverse penalty on the summed loss."""
    data = assemble(train, spec).persist()
    try:
        rows = data.count()
        model = LogisticRegression(
            regParam=1.0 / (strength * rows), elasticNetParam=0.0, standardization=False,
            maxIter=max_iter,
        ).fit(data)
    finally:
        data.unpersist()
    return PropensityModel(model, spec)


def fit_boosted(
    train: DataFrame, spec: CausalSpec, holdout: float = 0.33, seed: int = 0,
    max_iter: int = 100, max_depth: int = 6, step: float = 0.3, tolerance: float = 0.001,
):
    """Boosted trees that stop once the held-out log loss no longer improves."""
    data, kept = persist_sized(assemble(train, spec).withColumn("held_out", share_of(spec.id, seed) < holdout))
    try:
        model = GBTClassifier(
            maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed,
            validationIndicatorCol="held_out", validationTol=tolerance,
        ).fit(data)
        out = PropensityModel(model, spec)
        checked = model.transform(data.where("held_out"))
        out.details["accuracy"] = checked.agg(
            F.avg((F.col("prediction") == F.col("label")).cast("int"))
        ).first()[0]
    finally:
        kept.unpersist()
    return out


def search_boosted(
    train: DataFrame, spec: CausalSpec, candidates: int = 40, folds: int = 5, seed: int = 0,
    space: dict | None = None, parallelism: int = 4,
):
    """Randomised search over the grid by stratified cross-validated accuracy."""
    base = GBTClassifier(seed=seed)
    builder = ParamGridBuilder()
    for name, values in (space or SEARCH_SPACE).items():
        builder = builder.addGrid(base.getParam(name), values)
    grid = builder.build()
    chosen = random.Random(seed).sample(grid, min(candidates, len(grid)))
    data = stratified_folds(assemble(train, spec), spec.id, "label", folds, seed).persist()
    try:
        fitted = CrossValidator(
            estimator=base, estimatorParamMaps=chosen, numFolds=folds, foldCol="fold",
            evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
            parallelism=parallelism,
        ).fit(data)
    finally:
        data.unpersist()
    trials = [
        {**{p.name: v for p, v in params.items()}, "accuracy": float(score)}
        for params, score in zip(chosen, fitted.avgMetrics)
    ]
    best = max(range(len(trials)), key=lambda i: trials[i]["accuracy"])
    return PropensityModel(fitted.bestModel, spec, {"trials": trials, "best": trials[best]})
