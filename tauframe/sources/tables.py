"""Scans and sinks over date-partitioned tables and CSV files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def partition_value(name: str) -> str:
    """``p_20240101`` and ``20240101`` both name the partition ``20240101``."""
    return name[2:] if name.startswith("p_") else name


def partition_name(value: str) -> str:
    return value if value.startswith("p_") else f"p_{value}"


def select_partitions(df: DataFrame, parts: Iterable[str] | None, column: str = "ds") -> DataFrame:
    """Keep the listed partitions; ``None`` keeps all."""
    if parts is None:
        return df
    return df.where(F.col(column).isin([partition_value(p) for p in parts]))


def read_partitions(
    spark: SparkSession, path: str, parts: Iterable[str] | None = None, column: str = "ds"
) -> DataFrame:
    """Scan a partitioned Parquet table, pruned to ``parts``.

    The partition column is declared as a string: an inferred number would lose the
    zeros in front of ``0001``, and the filter would no longer prune.
    """
    inferred = spark.read.option("mergeSchema", "false").parquet(path).schema
    fields = [StructField(f.name, StringType()) if f.name == column else f for f in inferred]
    return select_partitions(spark.read.schema(StructType(fields)).parquet(path), parts, column)


def sql_scan(spark: SparkSession, df: DataFrame, view: str, query: str | None = None) -> DataFrame:
    """Register ``df`` as a view and run SQL over it (``select *`` by default)."""
    df.createOrReplaceTempView(view)
    return spark.sql(query or f"select * from {view}")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header row; types are inferred only when no schema is given."""
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def write_partition(df: DataFrame, path: str, part: str | None = None, column: str = "ds") -> None:
    """Overwrite only the partitions present in ``df``; the others stay.

    With ``part`` all rows go to that partition, which is replaced even by no rows.
    """
    if part is not None:
        value = partition_value(part)
        df.drop(column).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{column}={value}")
        return
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)
