"""Side-by-side comparison of a Spark result and its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool"}.get(dtype.kind, "other")


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> list[str]:
    out = []
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return [f"columns {sorted(spark_pdf.columns)} vs {sorted(sql_pdf.columns)}"]
    for c in spark_pdf.columns:
        if kind(spark_pdf[c].dtype) != kind(sql_pdf[c].dtype):
            out.append(f"type of {c}: {spark_pdf[c].dtype} vs {sql_pdf[c].dtype}")
    if len(spark_pdf) != len(sql_pdf):
        out.append(f"rows {len(spark_pdf)} vs {len(sql_pdf)}")
    mine, theirs = rows_of(spark_pdf), rows_of(sql_pdf)
    odd = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if odd:
        out.append(f"{len(odd)} of {len(mine)} rows differ, first {odd[0]}")
    return out
