"""Nearest-neighbour matching on a one-dimensional score.

Rows are placed in one global order of (score, id). The k nearest rows of a unit
lie among its k predecessors and k successors, so the order is cut into blocks
of equal size by position, each block borrows k rows from its neighbours, and a
bounded window finds the candidates. Blocks are cut by position rather than by
score, so a score shared by a third of the rows is spread like any other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tauframe.operators.describe import caliper as caliper_of
from tauframe.operators.ordered import running_totals
from tauframe.session import checkpoint
from tauframe.spec import CausalSpec

BLOCK_ROWS = 20_000


def nearest_rows(
    df: DataFrame, spec: CausalSpec, score: str, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k nearest rows (the unit itself included) of every treated unit.

    Returns the stratum if any, the unit id, score and block, and ``near``: an
    array of (gap, step, pos, id, arm, score) sorted by score gap, then by
    distance in the order, then by position. Units without a score or stratum
    take no part.
    """
    by = [spec.stratum] if spec.stratum else []
    block_rows = max(block_rows, k)
    slim = df.select(
        *by, F.col(spec.id).alias("_id"), F.col(spec.treatment).cast("int").alias("_arm"),
        F.col(score).cast("double").alias("_score"),
    ).where(F.col("_score").isNotNull())
    for c in by:
        slim = slim.where(F.col(c).isNotNull())
    placed = running_totals(slim, [F.col("_score"), F.col("_id")], by=by).withColumn(
        "pos", F.col("pos") - 1
    )
    offset = F.col("pos") % block_rows
    home = F.floor(F.col("pos") / block_rows)
    copies = F.array_compact(F.array(
        home,
        F.when((offset < k) & (home > 0), home - 1),
        F.when(offset >= block_rows - k, home + 1),
    ))
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(copies))
    around = Window.partitionBy(*by, "_block").orderBy("pos").rowsBetween(-k, k)
    seen = F.collect_list(F.struct("pos", "_id", "_arm", "_score")).over(around)
    treated = spread.withColumn("_seen", seen).where(
        (F.col("_home") == F.col("_block")) & (F.col("_arm") == 1)
    )
    ranked = F.array_sort(F.transform(
        "_seen",
        lambda r: F.struct(
            F.abs(r["_score"] - F.col("_score")).alias("gap"),
            F.abs(r["pos"] - F.col("pos")).alias("step"),
            r["pos"].alias("pos"), r["_id"].alias("id"),
            r["_arm"].alias("arm"), r["_score"].alias("score"),
        ),
    ))
    return treated.select(
        *by, F.col("_id").alias(spec.id), F.col("_score").alias("score"),
        F.col("_block").alias("block"), F.slice(ranked, 1, k).alias("near"),
    )


def neighbour_pairs(
    df: DataFrame, spec: CausalSpec, score: str, k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per treated unit and neighbour: id, rank, neighbour id, arm and gap."""
    near = nearest_rows(df, spec, score, k, block_rows)
    by = [spec.stratum] if spec.stratum else []
    return near.select(*by, spec.id, F.posexplode("near").alias("rank", "r")).select(
        *by, spec.id, (F.col("rank") + 1).alias("rank"), F.col("r.id").alias("neighbour"),
        F.col("r.arm").alias("neighbour_arm"), F.col("r.gap").alias("gap"),
    )


def _choices(near: DataFrame) -> DataFrame:
    controls = F.filter("near", lambda r: r["arm"] == 0)
    return near.withColumn("near", controls).where(F.size("near") > 0)


def _within_caliper(pairs: DataFrame, df: DataFrame, spec: CausalSpec, score: str, ratio: float):
    by = [spec.stratum] if spec.stratum else []
    scored = df.where(F.col(score).isNotNull())
    limits = caliper_of(scored, score, ratio, by)
    if by:
        return pairs.join(limits, by).where(F.col("gap") <= F.col("caliper")).drop("caliper")
    width = limits.first()["caliper"]
    return pairs.where(F.col("gap") <= F.lit(width))


def match_with_replacement(
    df: DataFrame, spec: CausalSpec, score: str, k: int = 10, ratio: float = 0.5,
    enforce_caliper: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each treated unit takes the first control among its k nearest rows."""
    by = [spec.stratum] if spec.stratum else []
    near = _choices(nearest_rows(df, spec, score, k, block_rows))
    pairs = near.select(
        *by, spec.id, F.col("near")[0]["id"].alias("matched_id"), F.col("near")[0]["gap"].alias("gap")
    )
    return _within_caliper(pairs, df, spec, score, ratio) if enforce_caliper else pairs


def _settle(columns: list[str]):
    """One block's proposals, run until each stops or leaves for another block."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        here = pdf["block"].iloc[0]
        unit = pdf["unit"].tolist()
        controls = [list(c) for c in pdf["controls"]]
        homes = [list(b) for b in pdf["homes"]]
        turn = pdf["turn"].tolist()
        place = [here] * len(unit)
        moving = [False] * len(unit)
        holder: dict = {}
        for first in range(len(unit)):
            current = first
            while turn[current] < len(controls[current]):
                target = homes[current][turn[current]]
                if target != here:
                    place[current], moving[current] = target, True
                    break
                control = controls[current][turn[current]]
                rival = holder.get(control)
                if rival is None:
                    holder[control] = current
                    break
                if unit[current] < unit[rival]:
                    holder[control], current = current, rival
                turn[current] += 1
        out = pdf.copy()
        out["block"], out["turn"], out["moving"] = place, turn, moving
        return out[columns]

    return settle


def match_without_replacement(
    df: DataFrame, spec: CausalSpec, score: str, k: int = 10, ratio: float = 0.5,
    enforce_caliper: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Greedy 1:1 matching: units in id order take their nearest free control.

    All controls prefer the unit with the smaller id, so the sequential result
    equals the unique stable matching, which proposals reach in any order. Each
    block settles its own proposals in a task; a unit whose next choice lives in
    a neighbouring block moves there, and rounds go on until none moves.
    """
    by = [spec.stratum] if spec.stratum else []
    rows = max(block_rows, k)
    near = _choices(nearest_rows(df, spec, score, k, rows))
    state = near.select(
        *by, F.col(spec.id).alias("unit"),
        F.transform("near", lambda r: r["id"]).alias("controls"),
        F.transform("near", lambda r: F.floor(r["pos"] / rows)).alias("homes"),
        F.transform("near", lambda r: r["gap"]).alias("gaps"),
        F.col("near")[0]["pos"].alias("_first"),
    )
    state = state.select(
        *[c for c in state.columns if c != "_first"],
        F.floor(F.col("_first") / rows).cast("long").alias("block"),
        F.lit(0).alias("turn"), F.lit(True).alias("moving"),
    )
    schema = StructType([
        StructField(f.name, {"block": LongType(), "turn": IntegerType(), "moving": BooleanType()}
                    .get(f.name, f.dataType))
        for f in state.schema.fields
    ])
    settle = _settle(schema.names)
    state = checkpoint(state.groupBy(*by, "block").applyInPandas(settle, schema))
    while True:
        touched = state.where("moving").select(*by, "block").distinct()
        if touched.isEmpty():
            break
        keys = [*by, "block"]
        busy = state.join(touched, keys, "left_semi").groupBy(*keys).applyInPandas(settle, schema)
        idle = state.join(touched, keys, "left_anti").select(*schema.names)
        state = checkpoint(idle.unionByName(busy))
    chosen = state.where(F.col("turn") < F.size("controls"))
    pairs = chosen.select(
        *by, F.col("unit").alias(spec.id), F.get("controls", F.col("turn")).alias("matched_id"),
        F.get("gaps", F.col("turn")).alias("gap"),
    )
    return _within_caliper(pairs, df, spec, score, ratio) if enforce_caliper else pairs


def eligible_strata(df: DataFrame, treatment: str, stratum: str) -> DataFrame:
    """Strata with at least one treated and one control unit."""
    return (
        df.where(F.col(stratum).isNotNull())
        .groupBy(stratum)
        .agg(F.count_if(F.col(treatment) == 1).alias("n_treatment"),
             F.count_if(F.col(treatment) == 0).alias("n_control"))
        .where("n_treatment >= 1 and n_control >= 1")
    )


def match_by_stratum(
    df: DataFrame, spec: CausalSpec, score: str, k: int = 10, ratio: float = 0.1,
    enforce_caliper: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Greedy 1:1 matching inside each eligible level of ``spec.stratum``, all at once."""
    keep = eligible_strata(df, spec.treatment, spec.stratum).select(spec.stratum)
    inside = df.join(keep, spec.stratum, "left_semi")
    return match_without_replacement(inside, spec, score, k, ratio, enforce_caliper, block_rows)


def attach_match(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """All original rows with ``matched_id``, null where there is no match."""
    return df.join(pairs.select(id_col, "matched_id"), id_col, "left")


def pair_table(
    df: DataFrame, pairs: DataFrame, id_col: str, casts: dict[str, str] | None = None,
    name: str = "matched_uid",
) -> DataFrame:
    """Matched treated units with their features and the id they are matched to."""
    out = df.join(pairs.select(id_col, F.col("matched_id").alias(name)), id_col)
    return out.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()})


def pair_copies(pairs: DataFrame, id_col: str, name: str = "copies") -> DataFrame:
    """How often each id stands in the matched sample: a control once per pair it is in."""
    both = pairs.select(F.explode(F.array(id_col, "matched_id")).alias(id_col))
    return both.groupBy(id_col).agg(F.count(F.lit(1)).alias(name))


def matched_sample(df: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Matched treated rows and the controls they point to, one row per pointer.

    Pointers are counted per id first, so the wide table is joined once.
    """
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    return df.join(pair_copies(pairs, id_col, "_copies"), id_col).select("*", repeat).drop("_copies", "_copy")


def semi_join(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_semi")
