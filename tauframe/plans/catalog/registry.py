"""Registration of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(column: Column | str) -> Column:
    """Rounded for comparison, without negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def q6(expression: str) -> str:
    """The SQL twin of :func:`r6`."""
    return f"round(({expression})::double, 6) + 0e0"


def with_(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# The multipliers of the 64-bit hash that Spark's xxhash64 uses.
XX1, XX2, XX3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
XX4, XX5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def hash_order_ctes(name: str, source: str, column: str, seed: int) -> list[str]:
    """Steps that end in ``name``: ``source`` with the signed hash ``h`` of a long id and a seed.

    The twin of :func:`tauframe.operators.ordered.hash_order`, in 128-bit arithmetic
    modulo 2**64, one step to a table so that no expression is repeated.
    """
    wide = lambda e: f"(({e})::UHUGEINT)"
    low = lambda e: f"(({e}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    times = lambda e, k: low(f"{wide(e)} * {wide(k)}")
    plus = lambda e, k: low(f"{wide(e)} + {wide(k)}")
    turn = lambda e, r: low(f"{wide(e)} * {wide(1 << r)} + {wide(e)} // {wide(1 << (64 - r))}")
    fold = lambda r: f"xor(h, h >> {r})"
    mix = [fold(33), times("h", XX2), fold(29), times("h", XX3), fold(32)]
    unsigned = f"CASE WHEN {column} < 0 THEN {column}::HUGEINT + 18446744073709551616 ELSE {column} END"
    steps = [
        times(unsigned, XX2), turn("h", 31), times("h", XX1), f"xor(h, {(42 + XX5 + 8) % 2**64}::UBIGINT)",
        turn("h", 27), times("h", XX1), plus("h", XX4), *mix,
        plus("h", (XX5 + 4) % 2**64), f"xor(h, {seed * XX1 % 2**64}::UBIGINT)",
        turn("h", 23), times("h", XX2), plus("h", XX3), *mix,
        "CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END::BIGINT",
    ]
    out, before = [], source
    for i, step in enumerate(steps):
        after = name if i == len(steps) - 1 else f"{name}_{i}"
        every = f"*, {step} AS h" if not i else f"* REPLACE ({step} AS h)"
        out.append(f"{after} AS (SELECT {every} FROM {before})")
        before = after
    return out
