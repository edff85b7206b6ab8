"""Cleaning, recoding, encoding and scaling.

Learned values (fill values, categories, ranges) are one small row per column.
They are computed in one aggregation and applied as literals, so applying them
is a plain projection that keeps pushdown and needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, NumericType, StringType


def drop_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_null_rows(df: DataFrame, columns=None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill(values)


def recode_when(df: DataFrame, column: str, condition: Column, value) -> DataFrame:
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def recode_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    return df.replace(mapping, subset=[column])


def prepend_constant(df: DataFrame, column: str, value) -> DataFrame:
    return df.select(F.lit(value).alias(column), "*")


def add_interaction(df: DataFrame, left: str, right: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{left}_x_{right}", F.col(left) * F.col(right))


def feature_columns(df: DataFrame, exclude) -> list[str]:
    """Column names not excluded, in table order."""
    excluded = set(exclude)
    return [c for c in df.columns if c not in excluded]


def lookup(df: DataFrame, condition: Column, column: str) -> DataFrame:
    """The value of ``column`` in a row that satisfies ``condition``."""
    return df.where(condition).select(column).limit(1)


def _columns_with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def most_frequent(df: DataFrame, columns) -> dict:
    """Most frequent value per column, the smallest on ties; null for empty columns.

    Columns are unpivoted by type and counted with map-side combine, so neither a
    frequent value nor a column with many values lands in one task.
    """
    groups: dict[str, list[str]] = {}
    for field in df.select(*columns).schema.fields:
        kind = field.dataType
        if isinstance(kind, IntegralType):
            groups.setdefault("long", []).append(field.name)
        elif isinstance(kind, (DoubleType, FloatType)):
            groups.setdefault("double", []).append(field.name)
        else:
            groups.setdefault(kind.simpleString(), []).append(field.name)
    modes: dict = {}
    for kind, names in groups.items():
        long = df.select(
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast(kind).alias("v")) for c in names])
            ).alias("s")
        ).select("s.*")
        counted = long.where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        best = counted.groupBy("c").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("b"))
        modes.update({r["c"]: r["v"] for r in best.select("c", "b.v").collect()})
    return {c: modes.get(c) for c in columns}


def _apply_fill(df: DataFrame, values: dict) -> DataFrame:
    fills = {
        c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
        for c, v in values.items()
        if v is not None
    }
    return df.withColumns(fills) if fills else df


def fill_mode(df: DataFrame, columns=None) -> DataFrame:
    """Replace nulls by the column's most frequent value (smallest on ties)."""
    needed = _columns_with_nulls(df, list(columns or df.columns))
    return _apply_fill(df, most_frequent(df, needed)) if needed else df


def fill_typed(df: DataFrame, columns=None) -> DataFrame:
    """Strings take their most frequent value, numbers their mean.

    Filled integer columns become doubles, since a mean need not be whole.
    """
    needed = _columns_with_nulls(df, list(columns or df.columns))
    if not needed:
        return df
    numeric = [c for c in needed if isinstance(df.schema[c].dataType, NumericType)]
    strings = [c for c in needed if isinstance(df.schema[c].dataType, StringType)]
    values = most_frequent(df, strings) if strings else {}
    if numeric:
        values.update(df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict())
        df = cast_columns(df, {c: "double" for c in numeric})
    return _apply_fill(df, values)


@dataclass(frozen=True)
class OneHot:
    """Indicator columns with categories learned once and reused on other tables."""

    categories: dict[str, tuple]
    separator: str = "_"

    @classmethod
    def fit(cls, df: DataFrame, columns) -> "OneHot":
        """Learn all values of ``columns``; see ``one_hot_sparse`` for very many."""
        return cls({
            c: tuple(sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()))
            for c in columns
        })

    @property
    def labels(self) -> dict[str, list[str]]:
        """Output names per column, no two the same, also where only dots or case differ."""
        taken: set[str] = set()
        out: dict[str, list[str]] = {}
        for c, values in self.categories.items():
            out[c] = []
            for v in values:
                # a dot in a column name would read as a field access
                plain = name = f"{c}{self.separator}{v}".replace(".", "_")
                copies = 1
                while name.lower() in taken:
                    copies += 1
                    name = f"{plain}{self.separator}{copies}"
                taken.add(name.lower())
                out[c].append(name)
        return out

    def names(self, column: str) -> list[str]:
        return self.labels[column]

    @property
    def output_columns(self) -> list[str]:
        return [n for names in self.labels.values() for n in names]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each column by its indicators; null and unseen values are all zero."""
        keep = [F.col(c) for c in df.columns if c not in self.categories]
        labels = self.labels
        flags = [
            F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(n)
            for c, values in self.categories.items()
            for v, n in zip(values, labels[c])
        ]
        return df.select(*keep, *flags)


def one_hot_sparse(df: DataFrame, columns, suffix: str = "_onehot") -> DataFrame:
    """Add a sparse indicator vector per column, for columns with very many values.

    The categories are a fitted index, not columns of the plan. Values are in text order;
    null has the last place.
    """
    columns = list(columns)
    index = [f"{c}{suffix}_index" for c in columns]
    indexed = StringIndexer(
        inputCols=columns, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"
    ).fit(df).transform(df)
    encoder = OneHotEncoder(
        inputCols=index, outputCols=[f"{c}{suffix}" for c in columns], dropLast=False, handleInvalid="keep")
    return encoder.fit(indexed).transform(indexed).drop(*index)


def date_dummies(df: DataFrame, date_column: str, prefix: str = "") -> tuple[DataFrame, list[str]]:
    """Append one ``_MMdd`` indicator per calendar day seen; returns the new names too."""
    key = F.date_format(date_column, "MMdd")
    days = [r[0] for r in df.select(key.alias("d")).where("d is not null").distinct().collect()]
    names = {d: f"{prefix}_{d}" for d in sorted(days)}
    out = df.select(
        "*", *[F.coalesce((key == d).cast("int"), F.lit(0)).alias(n) for d, n in names.items()]
    )
    return out, list(names.values())


def minmax_scale(df: DataFrame, columns) -> DataFrame:
    """Rescale to [0, 1]; a constant column becomes 0."""
    columns = list(columns)
    bounds = df.agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        low, high = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
        if low is None:
            continue
        span = float(high) - float(low)
        value = (F.col(c) - F.lit(float(low))) / F.lit(span) if span > 0 else F.lit(0.0)
        scaled[c] = F.when(F.col(c).isNotNull(), value)
    return df.withColumns(scaled)
