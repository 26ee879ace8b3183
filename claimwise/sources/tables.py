"""Inputs: the policy table (CSV with a fixed schema, or derived from the
driver's parquet tables) and the closed-form ``scored`` table used to test
the evaluation operators without training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The policy-table columns and their types.
POLICY_SCHEMA = T.StructType([
    T.StructField("IDpol", T.LongType(), False),
    T.StructField("ClaimNb", T.IntegerType(), True),
    T.StructField("Exposure", T.DoubleType(), True),
    T.StructField("Area", T.StringType(), True),
    T.StructField("VehPower", T.IntegerType(), True),
    T.StructField("VehAge", T.IntegerType(), True),
    T.StructField("DrivAge", T.IntegerType(), True),
    T.StructField("BonusMalus", T.IntegerType(), True),
    T.StructField("VehBrand", T.StringType(), True),
    T.StructField("VehGas", T.StringType(), True),
    T.StructField("Density", T.DoubleType(), True),
    T.StructField("Region", T.StringType(), True),
])

CATEGORICAL = ["Area", "VehBrand", "VehGas", "Region"]
CONTINUOUS = ["Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density"]
MODELS = ["standard", "poisson", "tweedie"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_policies_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: header CSV read with the fixed schema (no inference pass)."""
    return (spark.read.schema(POLICY_SCHEMA).option("header", True)
            .option("mode", "PERMISSIVE").csv(path))


def check_schema(df: DataFrame, schema: T.StructType = POLICY_SCHEMA) -> list[str]:
    """Missing or mistyped columns; ints are accepted where doubles are expected."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in schema.fields:
        if f.name not in have:
            problems.append(f"missing {f.name}")
        elif have[f.name] != f.dataType:
            numeric_ok = isinstance(f.dataType, T.DoubleType) and isinstance(have[f.name], T.NumericType)
            widen_ok = isinstance(f.dataType, (T.IntegerType, T.LongType)) and isinstance(
                have[f.name], (T.IntegerType, T.LongType, T.ShortType))
            if not (numeric_ok or widen_ok):
                problems.append(f"{f.name}: {have[f.name].simpleString()} != {f.dataType.simpleString()}")
    return problems


def conform(df: DataFrame, schema: T.StructType = POLICY_SCHEMA) -> DataFrame:
    """Cast to the fixed policy schema (column order and types)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy table derived from orders/customer/nation/lineitem/part.

    Plan shape: lineitem is reduced per order first (partial aggregation
    map-side, so the shuffle carries one row per order and partition), then
    joined to orders on the same key; customer joins on custkey; nation is the
    fixed 25-row TPC-H dimension and is broadcast; part is left to AQE, which
    broadcasts it only when its runtime size is under the threshold.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    lead = li.groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("lead_partkey"),
        F.count(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48), 1)).alias("claims"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
          .join(lead, o.o_orderkey == lead.l_orderkey, "left")
          .join(p, lead.lead_partkey == p.p_partkey, "left"))
    return j.selectExpr(
        "o_orderkey AS IDpol",
        "CAST(coalesce(claims, 0) AS BIGINT) AS ClaimNb",
        "o_totalprice / 500000.0D AS Exposure",
        "o_orderpriority AS Area",
        "CAST(4 + p_size % 12 AS INT) AS VehPower",
        "CAST(p_size % 21 AS INT) AS VehAge",
        "CAST(18 + c_custkey % 73 AS INT) AS DrivAge",
        "CAST(greatest(50, floor(c_acctbal / 50) - 50) AS INT) AS BonusMalus",
        "coalesce(p_brand, 'Brand#0') AS VehBrand",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Diesel' ELSE 'Regular' END AS VehGas",
        "CAST(1 + (c_custkey % 30) * (c_custkey % 30) * (c_custkey % 30) AS INT) AS Density",
        "n_name AS Region",
    )


def scored_from(pol: DataFrame) -> DataFrame:
    """Closed-form predictions for three 'models' (evaluation fixture)."""
    e = F.col("Exposure")
    return pol.select(
        "IDpol",
        F.col("ClaimNb").cast("bigint").alias("actual"),
        ((F.lit(1e4) + F.lit(4e2) * F.col("BonusMalus") + F.floor(F.lit(5e4) * F.least(e, F.lit(1e0))))
         / F.lit(1e6)).alias("predicted_standard"),
        ((F.floor(F.lit(8e4) * F.greatest(e, F.lit(5e-2))) + F.lit(2e3) * (F.col("DrivAge") % 7))
         / F.lit(1e6)).alias("predicted_poisson"),
        ((F.floor(F.lit(6e4) * F.greatest(e, F.lit(5e-2))) + F.lit(1e1) * (F.col("Density") % 1000))
         / F.lit(1e6)).alias("predicted_tweedie"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_from(policies(spark, sf_dir))


def long_scores(sc: DataFrame, models=MODELS) -> DataFrame:
    """scored (wide) -> (model, IDpol, actual, predicted): one scan, models as rows."""
    return sc.unpivot(["IDpol", "actual"], [f"predicted_{m}" for m in models], "model", "predicted") \
             .withColumn("model", F.regexp_replace("model", "^predicted_", ""))


# --- SQL text of the same inputs, for the DuckDB oracle --------------------

POLICIES_SQL = """
lead AS (
  SELECT l_orderkey, min(l_partkey) AS lead_partkey,
         count(CASE WHEN l_returnflag = 'R' AND l_quantity >= 48 THEN 1 END) AS claims
  FROM lineitem GROUP BY l_orderkey),
policies AS (
SELECT o.o_orderkey AS IDpol,
       CAST(coalesce(l.claims, 0) AS BIGINT) AS ClaimNb,
       o.o_totalprice / 500000.0 AS Exposure,
       o.o_orderpriority AS Area,
       CAST(4 + p.p_size % 12 AS INT) AS VehPower,
       CAST(p.p_size % 21 AS INT) AS VehAge,
       CAST(18 + c.c_custkey % 73 AS INT) AS DrivAge,
       CAST(greatest(50, floor(c.c_acctbal / 50) - 50) AS INT) AS BonusMalus,
       coalesce(p.p_brand, 'Brand#0') AS VehBrand,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'Diesel' ELSE 'Regular' END AS VehGas,
       CAST(1 + (c.c_custkey % 30) * (c.c_custkey % 30) * (c.c_custkey % 30) AS INT) AS Density,
       n.n_name AS Region
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN lead l ON o.o_orderkey = l.l_orderkey
LEFT JOIN part p ON l.lead_partkey = p.p_partkey)"""

SCORED_SQL = """
scored AS (
SELECT IDpol, ClaimNb AS actual,
       (1e4 + 4e2 * BonusMalus + floor(5e4 * least(Exposure, 1e0))) / 1e6 AS predicted_standard,
       (floor(8e4 * greatest(Exposure, 5e-2)) + 2e3 * (DrivAge % 7)) / 1e6 AS predicted_poisson,
       (floor(6e4 * greatest(Exposure, 5e-2)) + 1e1 * (Density % 1000)) / 1e6 AS predicted_tweedie
FROM policies),
long_scores AS (
  SELECT 'standard' AS model, IDpol, actual, predicted_standard AS predicted FROM scored
  UNION ALL SELECT 'poisson', IDpol, actual, predicted_poisson FROM scored
  UNION ALL SELECT 'tweedie', IDpol, actual, predicted_tweedie FROM scored)"""
