"""Propensity models, meta-learners, tournaments and the daily jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tauframe.operators import causal_forest as cf
from tauframe.operators import learners as le
from tauframe.operators import propensity, ranking, sampling
from tauframe.operators.prepare import minmax_scale
from tauframe.plans import daily_matching, daily_targeting
from tauframe.plans.catalog.fixtures import NUMERIC, SPEC, UNITS, predict_units, units
from tauframe.plans.catalog.registry import q6, query, rounded, with_
from tauframe.plans.catalog.trees import small_forests
from tauframe.spec import CausalSpec

def _scaled(spark, sf_dir):
    return minmax_scale(units(spark, sf_dir).select("uid", "treatment", "y", *NUMERIC), NUMERIC)


@query("propensity_logistic")
def propensity_logistic(spark, sf_dir):
    df = _scaled(spark, sf_dir)
    balanced = sampling.downsample_control(df, "uid", "treatment", 7)
    return propensity.fit_logistic(balanced, SPEC).score(df).select("uid", "treatment", "ps")


@query("propensity_boosted")
def propensity_boosted(spark, sf_dir):
    df = _scaled(spark, sf_dir)
    balanced = sampling.downsample_control(df, "uid", "treatment", 7)
    model = propensity.fit_boosted(balanced, SPEC, seed=7)
    return model.score(df).select("uid", "treatment", "ps")


QUICK_SPACE = {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.1, 0.3], "subsamplingRate": [0.5, 1.0]}


@query("propensity_search")
def propensity_search(spark, sf_dir):
    balanced = sampling.downsample_control(_scaled(spark, sf_dir), "uid", "treatment", 7)
    model = propensity.search_boosted(balanced, SPEC, candidates=3, folds=2, seed=7, space=QUICK_SPACE)
    return spark.createDataFrame(model.details["trials"])


@query("propensity_importance")
def propensity_importance(spark, sf_dir):
    balanced = sampling.downsample_control(_scaled(spark, sf_dir), "uid", "treatment", 7)
    return propensity.fit_boosted(balanced, SPEC, seed=7).importances(spark)


ONE = CausalSpec("uid", "treatment", "y", ("omonth",))


@query("t_learner_linear", with_(f"""
SELECT uid, {q6('(SELECT regr_intercept(y, omonth) FILTER (treatment = 1) - regr_intercept(y, omonth) FILTER (treatment = 0) FROM units) + omonth * (SELECT regr_slope(y, omonth) FILTER (treatment = 1) - regr_slope(y, omonth) FILTER (treatment = 0) FROM units)')} AS tau
FROM units""", UNITS))
def t_learner_linear(spark, sf_dir):
    df = units(spark, sf_dir)
    model = le.fit_t_learner(df, ONE, LinearRegression(solver="normal"), LinearRegression(solver="normal"))
    return rounded(model.predict(df, "tau").select("uid", "tau"), "tau")


@query("s_learner_linear", with_(f"""
SELECT uid, {q6('''(SELECT (covar_pop(treatment, y) * var_pop(omonth) - covar_pop(omonth, y) * covar_pop(treatment, omonth))
  / (var_pop(treatment) * var_pop(omonth) - covar_pop(treatment, omonth) ** 2) FROM units)''')} AS tau
FROM units""", UNITS))
def s_learner_linear(spark, sf_dir):
    df = units(spark, sf_dir)
    model = le.fit_s_learner(df, ONE, LinearRegression(solver="normal"))
    return rounded(model.predict(df, "tau").select("uid", "tau"), "tau")


def _learner(name: str):
    def run(spark, sf_dir):
        df = units(spark, sf_dir).select("uid", "treatment", "y", *NUMERIC)
        return le.LEARNERS[name](df, SPEC).predict(df, "tau").select("uid", "tau")

    return run


for _name, _short in (("learner_s_ite", "s_learner"), ("learner_t_ite", "t_learner"),
                      ("learner_x_ite", "x_learner"), ("learner_dr_ite", "dr_learner")):
    query(_short)(_learner(_name))


@query("model_tournament")
def model_tournament(spark, sf_dir):
    df = units(spark, sf_dir).select("uid", "treatment", "y", *NUMERIC)
    train, test = sampling.split(df, "uid", 0.67, 3)
    grid = {**cf.default_tree_grid(200), **small_forests(2, 200)}
    models = cf.fit_grid(train, "uid", "treatment", "y", NUMERIC, grid)
    scored = cf.predict_grid(test, models)
    return ranking.top_rows(ranking.qini_scores(scored, "treatment", "y", list(grid)), "qini", 6, "model")


def quick_targeting() -> daily_targeting.TargetingPlan:
    tree = cf.CausalTreeParams(min_samples_leaf=300, max_depth=3)
    return daily_targeting.TargetingPlan(
        spec=SPEC, categorical=("segment", "status"), leakage=("cust", "priority", "y_num", "y_bin", "yb"),
        tree_grid={"ctree_cmse": tree, "ctree_ttest": replace(tree, criterion="t_test")},
        forest_grid={"cforest_cmse": replace(tree, trees=2, bootstrap=True)}, top_models=3, top_features=5,
    )


def learner_targeting() -> daily_targeting.TargetingPlan:
    """All 6 + 7 + 4 kinds of model; forests of 3 trees and learners of 5 rounds."""
    return replace(
        quick_targeting(), tree_grid=cf.default_tree_grid(200), forest_grid=cf.default_forest_grid(200, trees=3),
        learner=le.boosted(max_iter=5), use_learners=True, top_models=17, top_features=15)


@query("tournament_rounds")
def tournament_rounds(spark, sf_dir):
    """Trees, forests and learners on all features, then refitted on the leader's top 15."""
    out = daily_targeting.target_tables(units(spark, sf_dir), predict_units(spark, sf_dir), learner_targeting())
    return out["first_round"].select(F.lit(1).alias("round"), "model", "qini").unionByName(
        out["ranking"].select(F.lit(2).alias("round"), "model", "qini"))


@query("top_features_fitted")
def top_features_fitted(spark, sf_dir):
    """The 15 features of highest importance in a fitted causal tree, encoded categories included."""
    plan = learner_targeting()
    train, _, features = daily_targeting.prepare_tables(units(spark, sf_dir), predict_units(spark, sf_dir), plan)
    grid = {"ctree_cmse": cf.default_tree_grid(200)["ctree_cmse"]}
    model = cf.fit_grid(train, SPEC.id, SPEC.treatment, SPEC.outcome, features, grid)["ctree_cmse"]
    return ranking.top_rows(model.importance_frame(spark), "importance", plan.top_features, "feature")


@query("targeting_output")
def targeting_output(spark, sf_dir):
    out = daily_targeting.target_tables(units(spark, sf_dir), predict_units(spark, sf_dir), quick_targeting())
    return out["targets"]


def quick_matching() -> daily_matching.MatchingPlan:
    return daily_matching.MatchingPlan(
        spec=SPEC, numeric=tuple(NUMERIC), categorical=("segment", "status"),
        recodes={"status": {"F": "finished", "O": "open"}}, casts={"omonth": "bigint"}, model="boosted",
    )


def _matching_input(spark, sf_dir):
    return units(spark, sf_dir).select("ds", "uid", "treatment", "y", *NUMERIC, "segment", "status")


@query("daily_matching_pairs")
def daily_matching_pairs(spark, sf_dir):
    return daily_matching.match_table(_matching_input(spark, sf_dir), quick_matching())["pairs"]


@query("daily_matching_balance")
def daily_matching_balance(spark, sf_dir):
    return daily_matching.match_table(_matching_input(spark, sf_dir), quick_matching())["balance"]


@query("targeting_train_scores")
def targeting_train_scores(spark, sf_dir):
    df = units(spark, sf_dir)
    tree = cf.fit_causal_tree(
        df, "uid", "treatment", "y", NUMERIC, cf.CausalTreeParams(min_samples_leaf=300, max_depth=3))
    return tree.predict(df, "score").select("ds", "uid", "treatment", F.col("score"))
