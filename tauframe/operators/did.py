"""Difference-in-differences regressions on panels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauframe.functions.stats import safe_divide, t_p_value
from tauframe.session import checkpoint


def trend_table(df: DataFrame, date: str, group: str, outcome: str) -> DataFrame:
    """Mean outcome per date and group."""
    return df.groupBy(date, group).agg(F.avg(outcome).alias("mean_outcome"))


def add_period(df: DataFrame, date: str, cutoff: str, name: str = "post") -> DataFrame:
    """0 before ``cutoff`` and 1 from then on."""
    return df.withColumn(name, (F.col(date) >= F.lit(cutoff).cast("date")).cast("int"))


def day_from_month_day(df: DataFrame, column: str, year: int = 2023, name: str = "dt") -> DataFrame:
    """A date from a month-day number such as 1204 or 704."""
    text = F.concat(F.lit(str(year)), F.lpad(F.col(column).cast("string"), 4, "0"))
    return df.withColumn(name, F.to_date(text, "yyyyMMdd"))


def independent_columns(gram: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Places of columns that are no constant and no combination of earlier ones.

    ``gram`` holds the columns' centred cross products. A sweep over it, on the scale of
    correlations, keeps a column only if something of it is left.
    """
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    solid = scale > 0
    left = gram / np.outer(np.where(solid, scale, 1.0), np.where(solid, scale, 1.0))
    kept = []
    for i in range(len(left)):
        if solid[i] and left[i, i] > tolerance:
            kept.append(i)
            left = left - np.outer(left[:, i], left[i, :]) / left[i, i]
    return kept


def _moments(columns: list[str]) -> list[Column]:
    """Row count, means and centred products of all pairs, each a stable one-pass aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    return [
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)],
        *[(F.covar_pop(columns[i], columns[j]) * F.count(F.lit(1))).alias(f"_p{i}_{j}") for i, j in pairs]]


def _square(row, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            out[i, j] = out[j, i] = row[f"_p{i}_{j}"] or 0.0
    return out


@dataclass
class _Fit:
    """Least squares from centred cross products; the last column is the outcome."""

    kept: list[int]
    slopes: np.ndarray
    inverse: np.ndarray
    residual: float
    variance: float | None
    dof: int

    @classmethod
    def of(cls, products: np.ndarray, n: int, absorbed: int) -> _Fit:
        gram, cross, total = products[:-1, :-1], products[:-1, -1], products[-1, -1]
        kept = independent_columns(gram)
        inverse = np.linalg.inv(gram[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
        slopes = inverse @ cross[kept]
        residual = max(0.0, float(total - slopes @ cross[kept]))
        dof = n - len(kept) - absorbed
        return cls(kept, slopes, inverse, residual, residual / dof if dof > 0 else None, dof)

    def error(self, weight: float) -> float | None:
        return None if self.variance is None else math.sqrt(max(0.0, self.variance * weight))

    def terms(self, names: list[str]) -> list[tuple]:
        return [(names[k], float(b), self.error(w)) for k, b, w in zip(self.kept, self.slopes, np.diag(self.inverse))]


def _number(value: float | None) -> str:
    return "cast(null AS double)" if value is None else f"double('{float(value)!r}')"


def _finished(terms: DataFrame, fit: _Fit, total: float) -> DataFrame:
    """term, estimate and std_error with t, p, R2 and degrees of freedom."""
    r2 = 1 - fit.residual / total if total > 0 else None
    return terms.select(
        "term", "estimate", "std_error", safe_divide(F.col("estimate"), F.expr("nullif(std_error, 0d)")).alias("t_stat"),
        F.lit(fit.dof).cast("long").alias("dof")).select(
        "term", "estimate", "std_error", "t_stat", t_p_value("t_stat", "dof").alias("p_value"),
        F.expr(_number(r2)).alias("r2"), "dof")


TERMS = "term string, estimate double, std_error double"


def _doubles(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The columns as doubles, without rows that miss one of them."""
    return df.select(*more, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]).dropna()


def ols(df: DataFrame, outcome: str, regressors: list[str]) -> DataFrame:
    """Least squares with intercept: term, estimate, standard error, t and p.

    One aggregation yields all centred cross products; what is left is algebra on a
    matrix of regressors by regressors. Aliased regressors are left out; list what must
    stay before what may go. Rows that miss a value are not used.
    """
    columns = [*regressors, outcome]
    names = [f"_c{i}" for i in range(len(columns))]
    row = _doubles(df, columns).agg(*_moments(names)).first()
    n, products = row["_n"], _square(row, len(columns))
    fit = _Fit.of(products, n, 1)
    terms = fit.terms(regressors)
    if n:
        means = np.array([row[f"_m{i}"] for i in range(len(columns))])
        at = means[fit.kept]
        terms.append(("intercept", float(means[-1] - at @ fit.slopes), fit.error(1 / n + float(at @ fit.inverse @ at))))
    return _finished(df.sparkSession.createDataFrame(terms, TERMS), fit, products[-1, -1])


def ols_with_effects(df: DataFrame, outcome: str, regressors: list[str], effect: Column, prefix: str = "_") -> DataFrame:
    """Least squares with one indicator for each value of ``effect`` but the smallest.

    The effects are partialled out instead of becoming columns: slopes come from the cross
    products inside the groups, which is the same fit (Frisch, Waugh and Lovell). An
    effect follows from its group's means, so any number of groups is a table of as many
    rows. Regressors that are constant inside every group are left out.
    """
    columns = [*regressors, outcome]
    names = [f"_c{i}" for i in range(len(columns))]
    width = len(columns)
    cells = checkpoint(_doubles(df, columns, effect.alias("_g")).groupBy("_g").agg(*_moments(names)))
    sums = cells.agg(
        F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_groups"), F.min("_g").alias("_base"),
        *[F.sum(f"_p{i}_{j}").alias(f"_p{i}_{j}") for i in range(width) for j in range(i + 1)],
        F.min_by(F.struct("_n", *[f"_m{i}" for i in range(width)]), "_g").alias("_first"),
        (F.sum(F.col("_n") * F.col(f"_m{width - 1}")) / F.sum("_n")).alias("_mean")).first()
    n, groups, first = sums["_n"] or 0, sums["_groups"], sums["_first"]
    fit = _Fit.of(_square(sums, width), n, groups)
    spark = df.sparkSession
    slopes = spark.createDataFrame(fit.terms(regressors), TERMS)
    if not n:
        return _finished(slopes, fit, 0.0)
    base = np.array([first[f"_m{i}"] for i in fit.kept])
    level = first[f"_m{width - 1}"] - float(base @ fit.slopes)
    start = spark.createDataFrame(
        [("intercept", level, fit.error(1 / first["_n"] + float(base @ fit.inverse @ base)))], TERMS)
    between = cells.agg(F.sum(F.expr(f"_n * pow(_m{width - 1} - {_number(sums['_mean'])}, 2)")).alias("b")).first()["b"]
    total = sums[f"_p{width - 1}_{width - 1}"] + between

    gaps = [f"(_m{i} - {_number(float(b))})" for i, b in zip(fit.kept, base)]
    fitted = " + ".join([f"{_number(level)}", *[f"_m{i} * {_number(float(b))}" for i, b in zip(fit.kept, fit.slopes)]])
    weight = " + ".join([f"1d / _n + 1d / {first['_n']}", *[
        f"{_number(float(fit.inverse[a, b]))} * {x} * {y}" for a, x in enumerate(gaps) for b, y in enumerate(gaps)]])
    others = cells.where(F.col("_g") != F.lit(sums["_base"])).selectExpr(
        f"concat('{prefix}', _g) AS term", f"_m{width - 1} - ({fitted}) AS estimate",
        f"sqrt(greatest(0d, ({weight}) * {_number(fit.variance)})) AS std_error")
    return _finished(slopes.unionByName(start).unionByName(others), fit, total)


def _interaction(df: DataFrame, period: str, group: str) -> tuple[DataFrame, str]:
    name = f"{period}_x_{group}"
    return df.withColumn(name, F.col(period) * F.col(group)), name


def did_regression(df: DataFrame, outcome: str, period: str, group: str) -> DataFrame:
    """Outcome on period, group and their product; the product is the effect."""
    data, effect = _interaction(df, period, group)
    return ols(data, outcome, [effect, group, period])


def parallel_trend_test(
    df: DataFrame, outcome: str, date: str, group: str, start: str, placebo: str
) -> DataFrame:
    """The same regression before ``start``, as if the policy began at ``placebo``."""
    before = df.where(F.col(date) < F.lit(start).cast("date"))
    return did_regression(add_period(before, date, placebo, "placebo"), outcome, "placebo", group)


def did_regression_by_date(df: DataFrame, outcome: str, date: str, period: str, group: str) -> DataFrame:
    """Outcome on date effects, group and period times group."""
    data, effect = _interaction(df, period, group)
    return ols_with_effects(data, outcome, [effect, group], F.date_format(date, "MMdd"))


def parallel_trend_test_by_date(
    df: DataFrame, outcome: str, date: str, group: str, start: str, placebo: str
) -> DataFrame:
    before = df.where(F.col(date) < F.lit(start).cast("date"))
    flagged = add_period(before, date, placebo, "placebo")
    return did_regression_by_date(flagged, outcome, date, "placebo", group)
