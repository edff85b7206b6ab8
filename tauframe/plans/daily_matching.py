"""Daily matching: clean, encode, score, match, write pairs, check balance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.operators import describe, matching, prepare, propensity, sampling
from tauframe.session import checkpoint
from tauframe.sources import tables
from tauframe.spec import CausalSpec


@dataclass(frozen=True)
class MatchingPlan:
    """What the job needs to know about its table.

    ``model`` is ``logistic``, ``boosted`` or ``search``. ``covariates`` are the
    columns of the propensity model; the outcome is only among them if listed.
    """

    spec: CausalSpec
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    recodes: dict = field(default_factory=dict)
    casts: dict = field(default_factory=dict)
    model: str = "boosted"
    model_options: dict = field(default_factory=dict)
    neighbours: int = 10
    ratio: float = 0.5
    seed: int = 20231212
    partition: str | None = "ds"


def clean(df: DataFrame, plan: MatchingPlan) -> DataFrame:
    """Fill, drop what is still incomplete and make the arm an integer."""
    filled = prepare.fill_mode(df)
    if plan.partition and plan.partition in filled.columns:
        filled = filled.drop(plan.partition)
    return prepare.cast_columns(prepare.drop_null_rows(filled), {plan.spec.treatment: "int"})


def encode(df: DataFrame, plan: MatchingPlan) -> tuple[DataFrame, CausalSpec]:
    """Recode, one-hot and scale; returns the spec with the encoded covariates."""
    for column, mapping in plan.recodes.items():
        df = prepare.recode_values(df, column, mapping)
    encoder = prepare.OneHot.fit(df, plan.categorical)
    wide = prepare.minmax_scale(encoder.transform(df), plan.numeric)
    return wide, plan.spec.with_covariates([*plan.numeric, *encoder.output_columns])


def fit_propensity(df: DataFrame, spec: CausalSpec, plan: MatchingPlan):
    balanced = sampling.downsample_control(df, spec.id, spec.treatment, plan.seed)
    fit = {
        "logistic": propensity.fit_logistic, "boosted": propensity.fit_boosted,
        "search": propensity.search_boosted,
    }[plan.model]
    options = dict(plan.model_options)
    if plan.model != "logistic":
        options.setdefault("seed", plan.seed)
    return fit(balanced, spec, **options)


def match_table(df: DataFrame, plan: MatchingPlan) -> dict[str, DataFrame]:
    """Scored units, pairs with original features and the diagnostics around them."""
    original = clean(df, plan)
    wide, spec = encode(original, plan)
    model = fit_propensity(wide, spec, plan)
    scored = checkpoint(model.score(wide))
    if spec.stratum:
        pairs = matching.match_by_stratum(scored, spec, "ps", plan.neighbours, plan.ratio)
    else:
        pairs = matching.match_without_replacement(scored, spec, "ps", plan.neighbours, plan.ratio)
    features = list(plan.numeric)
    copies = matching.pair_copies(pairs, spec.id)
    return {
        "comparison": describe.compare_arms(original, spec.treatment, spec.outcome),
        "balance_before": describe.balance_table(wide, spec.treatment, features),
        "scored": scored,
        "score_histogram": describe.score_histogram(scored, "ps", spec.treatment, 0.04),
        "pairs": matching.pair_table(original, pairs, spec.id, plan.casts),
        "balance": describe.balance_before_after(scored, copies, spec.id, spec.treatment, features),
    }


def run(
    spark: SparkSession, source: str, target: str, part: str, plan: MatchingPlan
) -> dict[str, DataFrame]:
    """Read one partition, match it and overwrite the same partition of ``target``."""
    raw = tables.read_partitions(spark, source, [part], plan.partition or "ds")
    out = match_table(raw, plan)
    tables.write_partition(out["pairs"], target, part, plan.partition or "ds")
    return out


def levels_after_matching(pairs: DataFrame, levels: DataFrame, id_col: str, level: str) -> DataFrame:
    """Distribution of a level column among matched treated units and their controls."""
    treated = matching.semi_join(levels, pairs, id_col).withColumn("arm", F.lit("treatment"))
    ids = pairs.select(F.col("matched_id").alias(id_col))
    control = matching.semi_join(levels, ids, id_col).withColumn("arm", F.lit("control"))
    return describe.level_distribution(treated.unionByName(control), "arm", level)
