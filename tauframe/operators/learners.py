"""S-, T-, X- and DR-learners on Spark ML regressors.

Kuenzel et al. (2019) for S, T and X; Kennedy (2020) for DR.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauframe.operators.sampling import share_of
from tauframe.session import persist_sized
from tauframe.spec import CausalSpec

# Fixed value: propensities are kept this far from 0 and 1.
PROPENSITY_FLOOR = 0.01


def boosted(max_iter: int = 100, max_depth: int = 3, step: float = 0.1, seed: int = 0) -> GBTRegressor:
    return GBTRegressor(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed)


def _clear(estimator: Estimator, label: str, prediction: str) -> Estimator:
    return estimator.copy({
        estimator.featuresCol: "_features", estimator.labelCol: label,
        estimator.predictionCol: prediction,
    })


@dataclass
class EffectModel:
    """Fitted stages and the expression that turns their outputs into an effect."""

    spec: CausalSpec
    stages: list
    effect: Column

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        out = _features(df, self.spec)
        for stage in self.stages:
            out = stage(out)
        return out.select(*df.columns, self.effect.alias(name))


def _features(df: DataFrame, spec: CausalSpec) -> DataFrame:
    return VectorAssembler(
        inputCols=list(spec.covariates), outputCol="_features", handleInvalid="error"
    ).transform(df)


def _training(df: DataFrame, spec: CausalSpec) -> DataFrame:
    return _features(df, spec).select(
        F.col(spec.id).alias("_id"), F.col(spec.treatment).cast("double").alias("_t"),
        F.col(spec.outcome).cast("double").alias("_y"), "_features",
    )


def _arm(data: DataFrame, arm: int) -> DataFrame:
    return data.where(F.col("_t") == arm)


def _keep(model, name: str):
    """A stage that adds only the model's prediction column."""
    return lambda df: model.transform(df).select(*df.columns, name)


def _together(*fits: Callable) -> list:
    """Results of fits that do not need each other, run at once: a round is a few short jobs."""
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(fit) for fit in fits]]


def _propensity(data: DataFrame, name: str = "_e"):
    model = LogisticRegression(
        featuresCol="_features", labelCol="_t", probabilityCol="_prob", rawPredictionCol="_raw",
        predictionCol="_label", regParam=1e-6, maxIter=100,
    ).fit(data)
    inside = F.greatest(
        F.lit(PROPENSITY_FLOOR), F.least(F.lit(1 - PROPENSITY_FLOOR), vector_to_array("_prob")[1])
    )
    return lambda df: model.transform(df).select(*df.columns, inside.alias(name))


def fit_s_learner(df: DataFrame, spec: CausalSpec, learner: GBTRegressor | None = None) -> EffectModel:
    """One outcome model with the arm as a feature, read at both arms."""
    learner = learner or boosted()
    widen = VectorAssembler(inputCols=["_features", "_t"], outputCol="_with_arm")
    data, kept = persist_sized(widen.transform(_training(df, spec)))
    try:
        model = learner.copy({
            learner.featuresCol: "_with_arm", learner.labelCol: "_y", learner.predictionCol: "_out"
        }).fit(data)
    finally:
        kept.unpersist()

    def at(arm: int, name: str):
        def stage(frame: DataFrame) -> DataFrame:
            wide = widen.transform(frame.withColumn("_t", F.lit(float(arm))))
            return model.transform(wide).select(*frame.columns, F.col("_out").alias(name))

        return stage

    return EffectModel(spec, [at(1, "_m1"), at(0, "_m0")], F.col("_m1") - F.col("_m0"))


def fit_t_learner(
    df: DataFrame, spec: CausalSpec, learner: Estimator | None = None,
    treated_learner: Estimator | None = None,
) -> EffectModel:
    """Separate outcome models per arm; the treated one is linear unless given."""
    data, kept = persist_sized(_training(df, spec))
    try:
        m0, m1 = _together(
            lambda: _clear(learner or boosted(), "_y", "_m0").fit(_arm(data, 0)),
            lambda: _clear(treated_learner or LinearRegression(), "_y", "_m1").fit(_arm(data, 1)))
    finally:
        kept.unpersist()
    return EffectModel(spec, [_keep(m0, "_m0"), _keep(m1, "_m1")], F.col("_m1") - F.col("_m0"))


def fit_x_learner(
    df: DataFrame, spec: CausalSpec, learner: Estimator | None = None,
    effect_learner: Estimator | None = None,
) -> EffectModel:
    """Imputed effects of each arm, regressed and blended by the propensity."""
    learner, effect_learner = learner or boosted(), effect_learner or LinearRegression()
    data, kept = persist_sized(_training(df, spec))
    try:
        m0, m1, e = _together(
            lambda: _clear(learner, "_y", "_m0").fit(_arm(data, 0)),
            lambda: _clear(learner, "_y", "_m1").fit(_arm(data, 1)),
            lambda: _propensity(data))
        treated = m0.transform(_arm(data, 1)).withColumn("_d", F.col("_y") - F.col("_m0"))
        control = m1.transform(_arm(data, 0)).withColumn("_d", F.col("_m1") - F.col("_y"))
        tau1, tau0 = _together(
            lambda: _clear(effect_learner, "_d", "_tau1").fit(treated),
            lambda: _clear(effect_learner, "_d", "_tau0").fit(control))
    finally:
        kept.unpersist()
    blend = F.col("_e") * F.col("_tau0") + (1 - F.col("_e")) * F.col("_tau1")
    return EffectModel(spec, [_keep(tau0, "_tau0"), _keep(tau1, "_tau1"), e], blend)


def fit_dr_learner(
    df: DataFrame, spec: CausalSpec, learner: Estimator | None = None,
    effect_learner: Estimator | None = None, seed: int = 0,
) -> EffectModel:
    """Doubly robust pseudo-outcomes, cross-fitted over three rotating folds.

    In each rotation one fold fits the propensity, one the outcome models and
    the third the final regression; predictions average the three.
    """
    learner, effect_learner = learner or boosted(), effect_learner or LinearRegression()
    data, kept = persist_sized(_training(df, spec).withColumn("_fold", F.floor(share_of("_id", seed) * 3)))

    def rotation(r: int):
        fold = [data.where(F.col("_fold") == (r + k) % 3) for k in range(3)]
        e, m0, m1 = _together(
            lambda: _propensity(fold[0]),
            lambda: _clear(learner, "_y", "_m0").fit(_arm(fold[1], 0)),
            lambda: _clear(learner, "_y", "_m1").fit(_arm(fold[1], 1)))
        ready = _keep(m1, "_m1")(_keep(m0, "_m0")(e(fold[2])))
        t, y = F.col("_t"), F.col("_y")
        mine = F.when(t == 1, F.col("_m1")).otherwise(F.col("_m0"))
        pseudo = (
            (t - F.col("_e")) / (F.col("_e") * (1 - F.col("_e"))) * (y - mine)
            + F.col("_m1") - F.col("_m0")
        )
        tau = _clear(effect_learner, "_d", f"_tau{r}").fit(ready.withColumn("_d", pseudo))
        return _keep(tau, f"_tau{r}")

    try:
        stages = _together(*[lambda r=r: rotation(r) for r in range(3)])
    finally:
        kept.unpersist()
    return EffectModel(spec, stages, (F.col("_tau0") + F.col("_tau1") + F.col("_tau2")) / 3)


LEARNERS = {
    "learner_x_ite": fit_x_learner,
    "learner_s_ite": fit_s_learner,
    "learner_t_ite": fit_t_learner,
    "learner_dr_ite": fit_dr_learner,
}


def fit_learners(df: DataFrame, spec: CausalSpec, learner: GBTRegressor | None = None) -> dict[str, EffectModel]:
    return {name: fit(df, spec, learner) for name, fit in LEARNERS.items()}


def predict_learners(df: DataFrame, models: dict[str, EffectModel]) -> DataFrame:
    for name, model in models.items():
        df = model.predict(df, name)
    return df
