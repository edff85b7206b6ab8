"""Input frames of the catalogue, each with the CTE that builds it in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.spec import CausalSpec

SPEC = CausalSpec("uid", "treatment", "y", ("price", "acctbal", "omonth"))
NUMERIC = ["price", "acctbal", "omonth"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; outcomes are null for orders without lines."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("y_num"),
        F.max(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("y_bin"),
    )
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("cust"),
            F.date_format("o_orderdate", "yyyyMM").alias("ds"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("treatment"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("acctbal"),
            F.month("o_orderdate").alias("omonth"),
            F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"),
            "y_num", "y_bin",
        )
    )


RAW_UNITS = """raw_units AS (
  SELECT o.o_orderkey AS uid, o.o_custkey AS cust, strftime(o.o_orderdate, '%Y%m') AS ds,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS treatment,
         o.o_orderpriority AS priority, o.o_totalprice AS price, c.c_acctbal AS acctbal,
         month(o.o_orderdate)::int AS omonth, c.c_mktsegment AS segment, o.o_orderstatus AS status,
         l.y_num, l.y_bin
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*)::double AS y_num,
                    max(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) AS y_bin
             FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with both outcomes filled: ``y`` (line count) and ``yb`` (any return)."""
    return raw_units(spark, sf_dir).withColumns(
        {"y": F.coalesce("y_num", F.lit(0.0)), "yb": F.coalesce("y_bin", F.lit(0.0))}
    )


UNITS = RAW_UNITS + """,
units AS (SELECT *, coalesce(y_num, 0e0) AS y, coalesce(y_bin, 0e0) AS yb FROM raw_units)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("active_level"),
    )


LEVELS = """levels AS (
  SELECT c_custkey AS cust, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS active_level
  FROM customer)"""


def predict_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units to score: some arms unknown, one segment absent."""
    return units(spark, sf_dir).where(F.col("segment") != "FURNITURE").withColumn(
        "treatment", F.when(F.col("uid") % 5 != 0, F.col("treatment"))
    )


PREDICT = """predict_units AS (
  SELECT * REPLACE (CASE WHEN uid % 5 <> 0 THEN treatment END AS treatment)
  FROM units WHERE segment <> 'FURNITURE')"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean value of even and odd users; the policy starts on 16 January."""
    day = F.to_date("ts")
    return (
        table(spark, sf_dir, "events")
        .groupBy(day.alias("dt"), (F.col("user_id") % 2).cast("int").alias("category"))
        .agg(F.avg("value").alias("rate"))
        .withColumn("post", (F.col("dt") >= F.lit("2024-01-16").cast("date")).cast("int"))
    )


PANEL = """panel AS (
  SELECT ts::date AS dt, (user_id % 2)::int AS category, avg(value) AS rate,
         CASE WHEN ts::date >= DATE '2024-01-16' THEN 1 ELSE 0 END AS post
  FROM events GROUP BY 1, 2, 4)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily views and visitors per event type."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_format("ts", "yyyyMMdd").alias("ds"), "event_type")
        .agg(F.count(F.lit(1)).alias("pv"), F.countDistinct("user_id").alias("uv"))
        .withColumn("label", F.when(F.col("event_type") != "error", F.col("event_type")))
    )


DAILY = """daily AS (
  SELECT strftime(ts, '%Y%m%d') AS ds, event_type, count(*) AS pv, count(DISTINCT user_id) AS uv,
         CASE WHEN event_type <> 'error' THEN event_type END AS label
  FROM events GROUP BY 1, 2)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with closed-form scores: all distinct, its reverse, constant and stepwise."""
    s1 = F.col("price") / 500000.0 - F.col("acctbal") / 20000.0 + F.col("omonth") * 0.01
    return units(spark, sf_dir).withColumn("s1", s1).withColumns({
        "s2": -F.col("s1"), "s3": F.lit(0.5),
        "s4": F.floor(F.col("omonth") / 4.0).cast("double"),
    })


SCORED = UNITS + """,
scored AS (
  SELECT *, -s1 AS s2, 0.5e0 AS s3, floor(omonth / 4e0)::double AS s4
  FROM (SELECT *, price / 5e5 - acctbal / 2e4 + omonth * 1e-2 AS s1 FROM units))"""


def with_ps(df: DataFrame, bounds: dict) -> DataFrame:
    px = (F.col("price") - bounds["lp"]) / (bounds["hp"] - bounds["lp"])
    ax = (F.col("acctbal") - bounds["la"]) / (bounds["ha"] - bounds["la"])
    z = 1.2 * px - 0.8 * ax + 0.05 * F.col("omonth") - 0.6
    ps = F.round(1.0 / (1.0 + F.exp(-z)), 6)
    return df.withColumn("ps", ps).withColumn("ps_tied", F.floor(F.col("ps") * 50.0) / 50.0)


def propensity_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with a fixed logistic score and a coarse, heavily tied version of it."""
    df = units(spark, sf_dir)
    bounds = table(spark, sf_dir, "orders").agg(
        F.min("o_totalprice").alias("lp"), F.max("o_totalprice").alias("hp")
    ).first().asDict()
    bounds.update(table(spark, sf_dir, "customer").agg(
        F.min("c_acctbal").alias("la"), F.max("c_acctbal").alias("ha")
    ).first().asDict())
    return with_ps(df, bounds)


PS = UNITS + """,
ps_units AS (
  SELECT *, floor(ps * 5e1) / 5e1 AS ps_tied FROM (
    SELECT u.*, round(1e0 / (1e0 + exp(-(
      1.2e0 * ((price - lp) / (hp - lp)) - 0.8e0 * ((acctbal - la) / (ha - la)) + 0.05e0 * omonth - 0.6e0
    ))), 6) AS ps
    FROM units u,
         (SELECT min(o_totalprice) AS lp, max(o_totalprice) AS hp FROM orders),
         (SELECT min(c_acctbal) AS la, max(c_acctbal) AS ha FROM customer)))"""


def multi_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with five arms '0' to '4'."""
    arm = (F.substring("priority", 1, 1).cast("int") - 1).cast("string")
    return units(spark, sf_dir).withColumn("arm", arm)


MULTI = UNITS + """,
multi AS (SELECT *, (substr(priority, 1, 1)::int - 1)::varchar AS arm FROM units)"""
