"""Scans, cleaning, encoding, sampling and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tauframe.operators import prepare, sampling
from tauframe.plans.catalog.fixtures import (
    DAILY,
    NUMERIC,
    PANEL,
    PREDICT,
    RAW_UNITS,
    UNITS,
    daily,
    panel,
    predict_units,
    raw_units,
    units,
)
from tauframe.plans.catalog.registry import hash_order_ctes, q6, query, rounded, with_
from tauframe.session import _ensure_checkpoint_dir
from tauframe.sources import tables


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    _ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("scan_partition", with_(
    "SELECT uid, '0' || ds AS ds, treatment, price FROM units WHERE ds IN ('199701', '199702')", UNITS))
def scan_partition(spark, sf_dir):
    """A pruned scan of a partitioned table whose partition values start with a zero."""
    path = scratch(spark, "units-by-ds")
    df = units(spark, sf_dir).select("uid", "treatment", "price", F.concat(F.lit("0"), "ds").alias("ds"))
    tables.write_partition(df.repartition("ds"), path)
    return tables.read_partitions(spark, path, ["p_0199701", "0199702"]).select("uid", "ds", "treatment", "price")


@query("partition_names", with_(
    "SELECT DISTINCT ds, 'p_' || ds AS part FROM raw_units", RAW_UNITS))
def partition_names(spark, sf_dir):
    return raw_units(spark, sf_dir).select("ds").distinct().select(
        F.regexp_replace("ds", "^p_", "").alias("ds"), F.concat(F.lit("p_"), "ds").alias("part")
    )


@query("sql_select_all", with_("SELECT uid, cust, ds, treatment, price FROM units", UNITS))
def sql_select_all(spark, sf_dir):
    df = units(spark, sf_dir).select("uid", "cust", "ds", "treatment", "price")
    return tables.sql_scan(spark, df, "tauframe_units")


@query("sql_project_filter", with_("SELECT ds, event_type, uv FROM daily WHERE ds >= '20240110'", DAILY))
def sql_project_filter(spark, sf_dir):
    return tables.sql_scan(
        spark, daily(spark, sf_dir), "tauframe_daily",
        "select ds, event_type, uv from tauframe_daily where ds >= '20240110'",
    )


@query("sql_order_two_keys", with_(
    "SELECT ds, event_type, pv FROM daily WHERE ds >= '20240105' AND ds <= '20240125' ORDER BY ds, pv DESC",
    DAILY))
def sql_order_two_keys(spark, sf_dir):
    return tables.sql_scan(
        spark, daily(spark, sf_dir), "tauframe_daily_pv",
        "select ds, event_type, pv from tauframe_daily_pv where ds >= '20240105' and ds <= '20240125' "
        "order by ds, pv desc",
    )


@query("csv_scan", with_("SELECT strftime(dt, '%m%d')::int AS dt, post, category, " + q6("rate")
                         + " AS rate FROM panel", PANEL))
def csv_scan(spark, sf_dir):
    path = scratch(spark, "panel-csv")
    out = panel(spark, sf_dir).select(
        F.date_format("dt", "MMdd").cast("int").alias("dt"), "post", "category", "rate"
    )
    tables.write_csv(out, path)
    back = tables.read_csv(spark, path, "dt int, post int, category int, rate double")
    return rounded(back, "rate")


@query("write_read_partition", with_(
    "SELECT uid, treatment, ds FROM units WHERE ds IN ('199703', '199704')", UNITS))
def write_read_partition(spark, sf_dir):
    path = scratch(spark, "units-table")
    df = units(spark, sf_dir).select("uid", "treatment", "ds")
    tables.write_partition(df.where("ds in ('199703', '199705')"), path)
    tables.write_partition(df.where("ds in ('199704')"), path)
    tables.write_partition(df.where("ds in ('199703')"), path)
    return tables.read_partitions(spark, path, ["p_199703", "p_199704"])


@query("preview_rows", with_(
    "SELECT uid, price FROM units ORDER BY uid LIMIT 10", UNITS))
def preview_rows(spark, sf_dir):
    return tables.preview(units(spark, sf_dir).select("uid", "price").orderBy("uid"), 10)


@query("drop_rename_cast", with_(
    "SELECT uid AS unit_id, treatment::varchar AS treatment, omonth::bigint AS omonth, price FROM units", UNITS))
def drop_rename_cast(spark, sf_dir):
    df = prepare.drop_columns(
        units(spark, sf_dir),
        ["cust", "ds", "priority", "acctbal", "segment", "status", "y_num", "y_bin", "y", "yb"],
    )
    df = prepare.rename_columns(df, {"uid": "unit_id"})
    return prepare.cast_columns(df, {"treatment": "string", "omonth": "bigint"})


@query("drop_null_rows", with_(
    "SELECT uid, y_num, y_bin FROM raw_units WHERE y_num IS NOT NULL AND y_bin IS NOT NULL", RAW_UNITS))
def drop_null_rows(spark, sf_dir):
    return prepare.drop_null_rows(raw_units(spark, sf_dir).select("uid", "y_num", "y_bin"))


@query("fill_mode", with_("""
SELECT uid, coalesce(y_num, (SELECT y_num FROM raw_units WHERE y_num IS NOT NULL GROUP BY 1
                             ORDER BY count(*) DESC, 1 LIMIT 1)) AS y_num,
       coalesce(y_bin, (SELECT y_bin FROM raw_units WHERE y_bin IS NOT NULL GROUP BY 1
                        ORDER BY count(*) DESC, 1 LIMIT 1)) AS y_bin,
       coalesce(CASE WHEN cust % 7 <> 0 THEN segment END,
                (SELECT segment FROM raw_units WHERE cust % 7 <> 0 GROUP BY 1
                 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment
FROM raw_units""", RAW_UNITS))
def fill_mode(spark, sf_dir):
    df = raw_units(spark, sf_dir).select(
        "uid", "y_num", "y_bin", F.when(F.col("cust") % 7 != 0, F.col("segment")).alias("segment")
    )
    return prepare.fill_mode(df)


@query("fill_typed", with_(f"""
SELECT uid, {q6("coalesce(y_num, (SELECT avg(y_num) FROM raw_units))")} AS y_num,
       coalesce(CASE WHEN cust % 7 <> 0 THEN segment END,
                (SELECT segment FROM raw_units WHERE cust % 7 <> 0 GROUP BY 1
                 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment
FROM raw_units""", RAW_UNITS))
def fill_typed(spark, sf_dir):
    df = raw_units(spark, sf_dir).select(
        "uid", "y_num", F.when(F.col("cust") % 7 != 0, F.col("segment")).alias("segment")
    )
    return rounded(prepare.fill_typed(df), "y_num")


@query("fill_constant", with_(
    "SELECT uid, coalesce(treatment, 1) AS treatment FROM predict_units", UNITS, PREDICT))
def fill_constant(spark, sf_dir):
    return prepare.fill_constant(predict_units(spark, sf_dir).select("uid", "treatment"), {"treatment": 1})


@query("recode_conditional", with_("""
SELECT ds, CASE WHEN label IS NULL AND pv > 50 THEN 'all' ELSE label END AS label, pv,
       CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS event_type
FROM daily""", DAILY))
def recode_conditional(spark, sf_dir):
    df = daily(spark, sf_dir).select("ds", "label", "pv", "event_type")
    df = prepare.recode_when(df, "label", F.col("label").isNull() & (F.col("pv") > 50), "all")
    return prepare.recode_when(df, "event_type", F.col("event_type") == "view", "unknown")


@query("recode_dict", with_("""
SELECT uid, CASE status WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE status END AS status
FROM units""", UNITS))
def recode_dict(spark, sf_dir):
    df = units(spark, sf_dir).select("uid", "status")
    return prepare.recode_values(df, "status", {"F": "finished", "O": "open"})


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", with_(
    "SELECT uid, " + ", ".join(
        f"CASE WHEN segment = '{s}' THEN 1 ELSE 0 END AS segment_{s}" for s in SEGMENTS)
    + ", " + ", ".join(f"CASE WHEN status = '{s}' THEN 1 ELSE 0 END AS status_{s}" for s in "FOP")
    + " FROM predict_units", UNITS, PREDICT))
def one_hot(spark, sf_dir):
    encoder = prepare.OneHot.fit(units(spark, sf_dir), ["segment", "status"])
    return encoder.transform(predict_units(spark, sf_dir).select("uid", "segment", "status"))


@query("date_dummies", with_(
    "SELECT strftime(dt, '%Y%m%d') AS ds, category, " + ", ".join(
        f"CASE WHEN strftime(dt, '%m%d') = '01{d:02d}' THEN 1 ELSE 0 END AS _01{d:02d}" for d in range(1, 31))
    + " FROM panel", PANEL))
def date_dummies(spark, sf_dir):
    df, names = prepare.date_dummies(panel(spark, sf_dir), "dt")
    return df.select(F.date_format("dt", "yyyyMMdd").alias("ds"), "category", *names)


@query("minmax_scale", with_("SELECT uid, " + ", ".join(
    f"coalesce({q6(f'({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)')}, 0e0) AS {c}"
    for c in [*NUMERIC, "one"]) + " FROM (SELECT *, 1e0 AS one FROM units)", UNITS))
def minmax_scale(spark, sf_dir):
    columns = [*NUMERIC, "one"]
    df = units(spark, sf_dir).withColumn("one", F.lit(1.0)).select("uid", *columns)
    return rounded(prepare.minmax_scale(df, columns), *columns)


@query("add_partition_column", with_("SELECT '20240131' AS part, uid, treatment FROM units", UNITS))
def add_partition_column(spark, sf_dir):
    return prepare.prepend_constant(units(spark, sf_dir).select("uid", "treatment"), "part", "20240131")


_LISTED = ["price", "acctbal", "omonth", "segment", "status"]


@query("feature_list", with_(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS present, count(DISTINCT {c}) AS distinct_values FROM units"
    for c in _LISTED), UNITS))
def feature_list(spark, sf_dir):
    """The features left by exclusion, each with its filled and distinct values."""
    df = units(spark, sf_dir)
    names = prepare.feature_columns(
        df, ["uid", "cust", "ds", "treatment", "priority", "y_num", "y_bin", "y", "yb"]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("string").alias("v")) for n in names])
    values = df.select(F.explode(pairs).alias("p")).groupBy("p.feature", "p.v").agg(F.count("p.v").alias("n"))
    return values.groupBy("feature").agg(F.sum("n").alias("present"), F.count("v").alias("distinct_values"))


@query("filter_arm", with_("SELECT uid, price, y FROM units WHERE treatment = 1 AND y_num IS NOT NULL", UNITS))
def filter_arm(spark, sf_dir):
    return units(spark, sf_dir).where("treatment = 1 and y_num is not null").select("uid", "price", "y")


@query("point_lookup", with_(
    f"SELECT {q6('rate')} AS rate FROM panel WHERE dt = DATE '2024-01-16' AND category = 1", PANEL))
def point_lookup(spark, sf_dir):
    found = prepare.lookup(
        panel(spark, sf_dir),
        (F.col("dt") == F.lit("2024-01-16").cast("date")) & (F.col("category") == 1), "rate",
    )
    return rounded(found, "rate")


@query("row_positions", with_(
    "SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS row_id FROM units", UNITS))
def row_positions(spark, sf_dir):
    from tauframe.operators.ordered import running_totals

    df = running_totals(units(spark, sf_dir).select("uid"), [F.col("uid")])
    return df.select("uid", (F.col("pos") - 1).alias("row_id"))


@query("interaction_column", with_(
    "SELECT strftime(dt, '%Y%m%d') AS ds, category, post * category AS post_x_category FROM panel", PANEL))
def interaction_column(spark, sf_dir):
    df = prepare.add_interaction(panel(spark, sf_dir), "post", "category")
    return df.select(F.date_format("dt", "yyyyMMdd").alias("ds"), "category", "post_x_category")


@query("month_day_dates", with_(
    "SELECT category, '2024' || strftime(dt, '%m%d') AS ds, CASE WHEN dt >= DATE '2024-01-08' THEN 1 ELSE 0 END "
    "AS placebo FROM panel", PANEL))
def month_day_dates(spark, sf_dir):
    from tauframe.operators.did import add_period, day_from_month_day

    df = panel(spark, sf_dir).select(F.date_format("dt", "MMdd").cast("int").alias("md"), "category")
    df = add_period(day_from_month_day(df, "md", 2024), "dt", "2024-01-08", "placebo")
    return df.select("category", F.date_format("dt", "yyyyMMdd").alias("ds"), "placebo")


@query("union_align", with_("""
SELECT uid, treatment, y, NULL::varchar AS status FROM units WHERE treatment = 0
UNION ALL SELECT uid, treatment, NULL, status FROM units WHERE treatment = 1""", UNITS))
def union_align(spark, sf_dir):
    df = units(spark, sf_dir)
    return sampling.union_aligned(
        df.where("treatment = 0").select("uid", "treatment", "y"),
        df.where("treatment = 1").select("status", "uid", "treatment"),
    )


@query("sort_desc", with_("SELECT ds, event_type, pv FROM daily ORDER BY pv DESC, ds, event_type", DAILY))
def sort_desc(spark, sf_dir):
    return daily(spark, sf_dir).select("ds", "event_type", "pv").orderBy(F.desc("pv"), "ds", "event_type")


@query("exclude_columns", with_(
    "SELECT '_' || strftime(dt, '%m%d') AS dummy FROM panel GROUP BY 1", PANEL))
def exclude_columns(spark, sf_dir):
    df = panel(spark, sf_dir)
    wide, _ = prepare.date_dummies(df, "dt")
    names = prepare.feature_columns(wide, df.columns)
    pairs = F.array(*[F.struct(F.lit(n).alias("dummy"), F.col(n).alias("v")) for n in names])
    return wide.select(F.explode(pairs).alias("r")).where("r.v = 1").select("r.dummy").distinct()


@query("balance_downsample", with_("""
SELECT treatment, n FROM (SELECT 1 AS treatment, count(*) FILTER (treatment = 1) AS n FROM units
UNION ALL SELECT 0, least(count(*) FILTER (treatment = 1), count(*) FILTER (treatment = 0)) FROM units)""", UNITS))
def balance_downsample(spark, sf_dir):
    df = sampling.downsample_control(units(spark, sf_dir), "uid", "treatment", 7)
    return df.groupBy("treatment").agg(F.countDistinct("uid").alias("n"))


@query("balance_larger_arm", with_("""
SELECT t AS treatment, (SELECT least(count(*) FILTER (treatment = 1), count(*) FILTER (treatment = 0)) FROM units) AS n
FROM (VALUES (0), (1)) v(t)""", UNITS))
def balance_larger_arm(spark, sf_dir):
    df = sampling.downsample_larger_arm(units(spark, sf_dir), "uid", "treatment", 40, 42)
    return df.groupBy("treatment").agg(F.countDistinct("uid").alias("n"))


@query("balanced_sample_rows", with_("""
SELECT uid, treatment, y FROM (
  SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY h, uid) AS place,
    least(count(*) FILTER (treatment = 1) OVER (), count(*) FILTER (treatment = 0) OVER ()) AS n FROM hashed)
WHERE place <= n""", UNITS, *hash_order_ctes("hashed", "units", "uid", 40)))
def balanced_sample_rows(spark, sf_dir):
    df = sampling.downsample_larger_arm(units(spark, sf_dir), "uid", "treatment", 40, 42)
    return df.select("uid", "treatment", "y")


@query("hash_split", with_("""
SELECT uid, treatment, (((h % 1000000 + 1000000) % 1000000) / 1000000 < 0.67)::INT AS train FROM hashed""",
    UNITS, *hash_order_ctes("hashed", "units", "uid", 20231212)))
def hash_split(spark, sf_dir):
    return sampling.flag_train(units(spark, sf_dir), "uid", 0.67, 20231212).select("uid", "treatment", "train")


@query("stratified_folds", with_("""
SELECT treatment, fold, count(*) AS n FROM (
  SELECT treatment, (row_number() OVER (PARTITION BY treatment ORDER BY uid) - 1) % 5 AS fold FROM units)
GROUP BY 1, 2""", UNITS))
def stratified_folds(spark, sf_dir):
    df = sampling.stratified_folds(units(spark, sf_dir).select("uid", "treatment"), "uid", "treatment", 5, 3)
    return df.groupBy("treatment", F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("assemble_test_set", with_("""
SELECT uid, treatment, segment FROM units WHERE treatment = 0
UNION ALL SELECT uid, coalesce(treatment, 1), segment FROM predict_units""", UNITS, PREDICT))
def assemble_test_set(spark, sf_dir):
    score = prepare.fill_constant(predict_units(spark, sf_dir), {"treatment": 1})
    out = sampling.assemble_test_set(units(spark, sf_dir), score, "treatment")
    return out.select("uid", "treatment", "segment")


@query("honest_split", with_("""
SELECT uid, CASE WHEN ((h % 1000000 + 1000000) % 1000000) / 1000000 < 0.5 THEN 'estimation' ELSE 'growth' END AS part
FROM hashed""", UNITS, *hash_order_ctes("hashed", "units", "uid", 11)))
def honest_split(spark, sf_dir):
    growth, estimation = sampling.honest_split(units(spark, sf_dir), "uid", 0.5, 11)
    return growth.select("uid", F.lit("growth").alias("part")).unionByName(
        estimation.select("uid", F.lit("estimation").alias("part"))
    )
