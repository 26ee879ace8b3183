"""Registered queries: one per SURVEY §2 operator (or a themed group of
them). Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` and,
where the operator is expressible in SQL, the DuckDB oracle text producing
the same columns.

Floating results that come from transcendental functions or from sums whose
order differs between engines are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import profile as prof
from ..operators.ordering import exact_quantiles
from ..sources import tables as src
from . import oracle_sql as O

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def policies(spark, sf):
    return src.policies(spark, sf)


def features(spark, sf, **kw):
    return feat.engineer(src.policies(spark, sf), **kw)[0]


TRANSCENDENTAL = {"LogDensity", "LogExposure", "BM_Exp"}
# The variables of the correlation study.
KEY_VARS = ["ClaimNb", "Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density", "LogDensity"]
ENGINEERED_NUMERIC = ["LogExposure", "VehAge_DrivAge_Ratio", "DrivExperience", "PowerToExperience", "BM_Exp",
                      "BM_Power", "BM_Age", "CompositeRiskScore", "RiskFactorScore", "Area_Region", "Brand_Gas",
                      "VehAgePower"]


# ------------------------------------------------------------------ minimum slice
@query("f06_risk_segment_summary", O.FEATURES + """
SELECT RiskSegment, CAST(count(*) AS BIGINT) AS policies, CAST(sum(ClaimNb) AS BIGINT) AS claims,
       round(sum(Exposure), 6) AS exposure, round(sum(ClaimNb) / sum(Exposure), 6) AS frequency,
       round(count(*) * 1e2 / (SELECT count(*) FROM features), 6) AS share_pct
FROM features GROUP BY RiskSegment""")
def q_risk_segment_summary(spark, sf):
    s = prof.segment_summary(features(spark, sf), "RiskSegment")
    return s.select("RiskSegment", "policies", "claims", r6("exposure").alias("exposure"),
                    r6("frequency").alias("frequency"), r6("share_pct").alias("share_pct"))


# ------------------------------------------------------------------ A: sources
@query("a01_policy_scan", O.POLICIES + "SELECT * FROM policies")
def q_policy_scan(spark, sf):
    return policies(spark, sf)


@query("a02_shape", O.FEATURES + "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(53 AS INT) AS n_columns FROM features")
def q_shape(spark, sf):
    return prof.shape(features(spark, sf))


_POLICY_COLS = [f.name for f in src.POLICY_SCHEMA.fields]


@query("a03_null_profile", O.POLICIES + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM policies"
    for c in _POLICY_COLS))
def q_null_profile(spark, sf):
    return prof.null_profile(policies(spark, sf), _POLICY_COLS)


_DOUBLE_FEATURES = ["Exposure", "VehPower", "VehAge", "LogDensity", "LogExposure", "VehAge_DrivAge_Ratio",
                    "PowerToExperience", "InexperiencePowerRatio", "BM_Exp", "BM_Power", "BM_Age",
                    "RiskFactorScore", "VehAgePower"]


@query("a04_inf_profile", O.FEATURES + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(CASE WHEN abs({c}) = 'inf'::DOUBLE THEN 1 END) AS BIGINT) AS n_inf "
    f"FROM features" for c in _DOUBLE_FEATURES))
def q_inf_profile(spark, sf):
    return prof.inf_profile(features(spark, sf))


@query("a05_preview", O.POLICIES + "SELECT * FROM policies ORDER BY IDpol LIMIT 5")
def q_preview(spark, sf):
    return prof.preview(policies(spark, sf))


# ------------------------------------------------------------------ B: features
def _feature_dump(df: DataFrame, cols) -> DataFrame:
    return df.select(*[(r6(c).alias(c) if c in TRANSCENDENTAL else F.col(c)) for c in cols])


def _sql_dump(cols) -> str:
    return O.FEATURES + "SELECT " + ", ".join(
        f"round({c}, 6) AS {c}" if c in TRANSCENDENTAL else c for c in cols) + " FROM features"


B_EXPOSURE_DENSITY = ["IDpol", "VeryShortExposure", "LogDensity", "DensityGroup"]
B_VEHICLE_DRIVER = ["IDpol", "LogExposure", "VehAge_DrivAge_Ratio", "NewVehicle", "YoungVehicle", "MatureVehicle",
                    "OldVehicle", "VeryOldVehicle", "TeenDriver", "YoungDriver", "AdultDriver", "SeniorDriver",
                    "DrivExperience", "VeryNoviceDriver", "NoviceDriver", "ModerateExperienceDriver",
                    "ExperiencedDriver"]
B_POWER_BONUS = ["IDpol", "PowerToExperience", "LowPower", "MediumPower", "HighPower", "VeryHighPower",
                 "YoungDriverHighPower", "NewDriverNewCar", "InexperiencePowerRatio", "BM_Exp", "BM_Power",
                 "BM_Age", "HighRiskBM", "ModerateRiskBM", "LowRiskBM", "BM_Segment"]
B_RISK = ["IDpol", "HighDensityBM", "CompositeRiskScore", "RiskSegment", "RiskFactorScore", "Area_Region",
          "Brand_Gas", "VehAgePower"]


@query("b01_exposure_density_columns", _sql_dump(B_EXPOSURE_DENSITY))
def q_b01(spark, sf):
    return _feature_dump(features(spark, sf), B_EXPOSURE_DENSITY)


@query("b04_vehicle_driver_columns", _sql_dump(B_VEHICLE_DRIVER))
def q_b04(spark, sf):
    return _feature_dump(features(spark, sf), B_VEHICLE_DRIVER)


@query("b20_power_bonus_columns", _sql_dump(B_POWER_BONUS))
def q_b20(spark, sf):
    return _feature_dump(features(spark, sf), B_POWER_BONUS)


@query("b35_risk_score_columns", _sql_dump(B_RISK))
def q_b35(spark, sf):
    return _feature_dump(features(spark, sf), B_RISK)


FEATURE_COLUMNS = ["IDpol", "ClaimNb", "Exposure", "Area", "VehPower", "VehAge", "DrivAge", "BonusMalus",
                   "VehBrand", "VehGas", "Density", "Region", "VeryShortExposure", "LogDensity", "DensityGroup",
                   *B_VEHICLE_DRIVER[1:], *B_POWER_BONUS[1:], *B_RISK[1:]]


@query("b00_feature_table", _sql_dump(FEATURE_COLUMNS))
def q_b00(spark, sf):
    return _feature_dump(features(spark, sf), FEATURE_COLUMNS)


_NB_DUMP = ["IDpol", "VehPower", "VehAge", "VehAge_DrivAge_Ratio", "PowerToExperience", "BM_Power",
            "CompositeRiskScore", "RiskSegment", "RiskFactorScore", "VehAgePower", "NewVehicle", "MatureVehicle"]


@query("b00_feature_table_notebook", O.with_ctes(src.POLICIES_SQL, O.features_sql("mean", "notebook")) + "SELECT "
       + ", ".join(f"round({c}, 9) AS {c}" if c in ("VehPower", "VehAge", "VehAge_DrivAge_Ratio", "PowerToExperience",
                                                    "BM_Power", "RiskFactorScore", "VehAgePower") else c
                   for c in _NB_DUMP) + " FROM features")
def q_b00_notebook(spark, sf):
    """Notebook path: mean fill (D4) and RiskFactorScore over DrivAge + 1."""
    f = features(spark, sf, impute="mean", variant="notebook")
    nine = {"VehPower", "VehAge", "VehAge_DrivAge_Ratio", "PowerToExperience", "BM_Power", "RiskFactorScore",
            "VehAgePower"}
    return f.select(*[F.round(c, 9).alias(c) if c in nine else F.col(c) for c in _NB_DUMP])


@query("b38_risk_factor_notebook", O.FEATURES + """
SELECT IDpol, round(VehPower * BonusMalus / (DrivAge + 1), 9) AS RiskFactorScore FROM features""")
def q_b38_notebook(spark, sf):
    f = features(spark, sf, variant="notebook")
    return f.select("IDpol", F.round("RiskFactorScore", 9).alias("RiskFactorScore"))


# ------------------------------------------------------------------ D: cleaning
@query("d01_label_codes", O.FEATURES + "SELECT column_name, value, code FROM codes")
def q_label_codes(spark, sf):
    return feat.fit_codes(policies(spark, sf))


@query("d03_median_fill_values", O.FEATURES + """
SELECT column_name, n_null, fill FROM (
  SELECT 'VehPower' AS column_name, CAST(count(*) - count(VehPower) AS BIGINT) AS n_null,
         CAST(median(VehPower) AS DOUBLE) AS fill FROM base
  UNION ALL
  SELECT 'VehAge', CAST(count(*) - count(VehAge) AS BIGINT), CAST(median(VehAge) AS DOUBLE) FROM base) t""")
def q_median_fill(spark, sf):
    return _fill_values(spark, sf, "median")


@query("d04_mean_fill_values", O.FEATURES + """
SELECT column_name, n_null, round(fill, 9) AS fill FROM (
  SELECT 'VehPower' AS column_name, CAST(count(*) - count(VehPower) AS BIGINT) AS n_null,
         avg(VehPower) AS fill FROM base
  UNION ALL
  SELECT 'VehAge', CAST(count(*) - count(VehAge) AS BIGINT), avg(VehAge) FROM base) t""")
def q_mean_fill(spark, sf):
    return _fill_values(spark, sf, "mean").withColumn("fill", F.round("fill", 9))


def _fill_values(spark, sf, strategy):
    """Fill value per column that has nulls, fitted after D1 and B1-B3."""
    pol = policies(spark, sf)
    codes = feat.fit_codes(pol)
    staged = feat.blank_non_finite(feat.base_columns(feat.apply_codes(pol, codes)))
    fills = feat.fit_fill_values(staged, strategy)
    nulls = prof.null_profile(staged, list(fills))
    vals = spark.createDataFrame([(k, float(v)) for k, v in fills.items()], "column_name string, fill double")
    return nulls.join(vals, "column_name").select("column_name", "n_null", "fill")


@query("d05_segment_codes", O.FEATURES + """
SELECT IDpol,
       CASE BM_Segment WHEN 'Base (50)' THEN 0 WHEN 'Moderate (51-75)' THEN 1 WHEN 'High (76-100)' THEN 2
            WHEN 'Very High (>100)' THEN 3 ELSE -1 END AS BM_Segment,
       CASE RiskSegment WHEN 'High' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE -1 END AS RiskSegment
FROM features""")
def q_segment_codes(spark, sf):
    return feat.segment_codes(features(spark, sf)).select("IDpol", "BM_Segment", "RiskSegment")


@query("d06_first_appearance_codes", O.FEATURES + """
SELECT column_name, value, CAST(row_number() OVER (PARTITION BY column_name ORDER BY first_id, value) - 1 AS INT) AS code
FROM (SELECT 'RiskSegment' AS column_name, RiskSegment AS value, min(IDpol) AS first_id FROM features GROUP BY 2
      UNION ALL SELECT 'BM_Segment', BM_Segment, min(IDpol) FROM features GROUP BY 2) t""")
def q_first_appearance(spark, sf):
    return feat.fit_codes(features(spark, sf), ["RiskSegment", "BM_Segment"], order="first")


# ------------------------------------------------------------------ E3 / F11
@query("e03_density_thresholds", O.FEATURES + """
SELECT round(mean_density, 6) AS mean_density, round(q90_density, 6) AS q90_density,
       CAST(count(CASE WHEN Density > mean_density THEN 1 END) AS BIGINT) AS n_above_mean,
       CAST(count(CASE WHEN Density > q90_density THEN 1 END) AS BIGINT) AS n_above_q90
FROM filled CROSS JOIN th GROUP BY mean_density, q90_density""")
def q_density_thresholds(spark, sf):
    """Scalars used on every row: mean and 0.9 quantile (by the checked quantile operator),
    each evaluated once as a scalar subquery and compared per row."""
    pol = policies(spark, sf)
    cleaned, _ = feat.clean(pol)
    mean = cleaned.agg(F.avg("Density")).scalar()
    q90 = exact_quantiles(cleaned, "Density", [0.9]).select("quantile").scalar()
    j = cleaned.select("Density", mean.alias("mean_density"), q90.alias("q90_density"))
    return j.groupBy("mean_density", "q90_density").agg(
        F.count(F.when(F.col("Density") > F.col("mean_density"), 1)).cast("bigint").alias("n_above_mean"),
        F.count(F.when(F.col("Density") > F.col("q90_density"), 1)).cast("bigint").alias("n_above_q90"),
    ).select(r6("mean_density").alias("mean_density"), r6("q90_density").alias("q90_density"),
             "n_above_mean", "n_above_q90")


# ------------------------------------------------------------------ F: profiles
@query("f01_claim_counts", O.POLICIES + """
SELECT ClaimNb, CAST(count(*) AS BIGINT) AS count FROM policies GROUP BY ClaimNb ORDER BY ClaimNb""")
def q_claim_counts(spark, sf):
    return prof.value_counts(policies(spark, sf), "ClaimNb")


@query("c01_claim_counts_below_5", O.POLICIES + """
SELECT ClaimNb, CAST(count(*) AS BIGINT) AS count FROM policies WHERE ClaimNb < 5 GROUP BY ClaimNb""")
def q_claims_below5(spark, sf):
    return prof.value_counts(policies(spark, sf).where("ClaimNb < 5"), "ClaimNb")


@query("c02_claim_class_counts", O.POLICIES + """
SELECT CASE WHEN ClaimNb = 0 THEN 'none' WHEN ClaimNb = 1 THEN 'one' WHEN ClaimNb > 1 THEN 'many' END AS claim_class,
       CAST(count(*) AS BIGINT) AS n FROM policies GROUP BY 1""")
def q_claim_class(spark, sf):
    return policies(spark, sf).groupBy(prof.claim_class().alias("claim_class")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("f02_claim_shares", O.POLICIES + """
SELECT round(avg(CAST(ClaimNb = 0 AS DOUBLE)) * 100, 6) AS pct_zero,
       round(avg(CAST(ClaimNb = 1 AS DOUBLE)) * 100, 6) AS pct_one,
       round(avg(CAST(ClaimNb > 1 AS DOUBLE)) * 100, 6) AS pct_many,
       round(avg(CAST(Exposure < 5e-2 AS DOUBLE)) * 100, 6) AS pct_very_short FROM policies""")
def q_claim_shares(spark, sf):
    s = prof.claim_shares(policies(spark, sf))
    return s.select(*[r6(c).alias(c) for c in s.columns])


_DESCRIBE_VARS = ["Density", "LogDensity", "CompositeRiskScore", "RiskFactorScore", "ClaimNb"]


@query("f04_describe", O.FEATURES + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM features"
    for c in _DESCRIBE_VARS).replace("CAST(min(LogDensity) AS DOUBLE)", "round(min(LogDensity), 6)")
    .replace("CAST(max(LogDensity) AS DOUBLE)", "round(max(LogDensity), 6)"))
def q_describe(spark, sf):
    d = prof.describe(features(spark, sf), _DESCRIBE_VARS)
    minmax = lambda c: F.when(F.col("variable") == "LogDensity", r6(c)).otherwise(F.col(c))
    return d.select("variable", "count", r6("mean").alias("mean"), r6("std").alias("std"),
                    minmax("min").alias("min"), r6("p25").alias("p25"), r6("p50").alias("p50"),
                    r6("p75").alias("p75"), minmax("max").alias("max"))


@query("f05_distinct_counts", O.POLICIES + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM policies"
    for c in src.CATEGORICAL))
def q_distinct(spark, sf):
    return prof.distinct_counts(policies(spark, sf), src.CATEGORICAL)


@query("f06_risk_segment_share", O.FEATURES + """
SELECT RiskSegment, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1e2 / (SELECT count(*) FROM features), 6) AS pct
FROM features GROUP BY RiskSegment""")
def q_segment_share(spark, sf):
    return prof.segment_share(features(spark, sf), "RiskSegment").withColumn("pct", r6("pct"))


@query("f07_claims_by_bm_segment", O.FEATURES + """
SELECT BM_Segment, round(avg(ClaimNb), 6) AS mean_claims, CAST(count(*) AS BIGINT) AS count,
       round(avg(ClaimNb) * 100, 6) AS mean_pct FROM features GROUP BY BM_Segment""")
def q_bm_segment(spark, sf):
    m = prof.mean_by(features(spark, sf), "BM_Segment")
    return m.select("BM_Segment", r6("mean_claims").alias("mean_claims"), "count", r6("mean_pct").alias("mean_pct"))


@query("f08_claims_by_category", O.POLICIES + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, round(avg(ClaimNb), 6) AS mean_claims "
    f"FROM policies GROUP BY {c}" for c in src.CATEGORICAL))
def q_claims_by_category(spark, sf):
    m = prof.mean_by_categories(policies(spark, sf), src.CATEGORICAL)
    return m.withColumn("mean_claims", r6("mean_claims"))


_CORR_VARS = KEY_VARS + ENGINEERED_NUMERIC


@query("f09_correlation_matrix", O.FEATURES + " UNION ALL ".join(
    f"SELECT '{_CORR_VARS[i]}' AS var_x, '{_CORR_VARS[j]}' AS var_y, "
    f"round(corr(CAST({_CORR_VARS[i]} AS DOUBLE), CAST({_CORR_VARS[j]} AS DOUBLE)), 6) AS corr FROM features"
    for i in range(len(_CORR_VARS)) for j in range(i)))
def q_corr(spark, sf):
    return prof.correlation_pairs(features(spark, sf), _CORR_VARS).withColumn("corr", r6("corr"))


@query("f10_claim_class_means", O.POLICIES + """
SELECT claim_class, variable, round(mean, 6) AS mean,
       round(mean / max(CASE WHEN claim_class = 'none' THEN mean END) OVER (PARTITION BY variable), 6) AS ratio_to_none
FROM (
  SELECT CASE WHEN ClaimNb = 0 THEN 'none' WHEN ClaimNb = 1 THEN 'one' WHEN ClaimNb > 1 THEN 'many' END AS claim_class,
         avg(Exposure) AS Exposure, avg(VehPower) AS VehPower, avg(VehAge) AS VehAge, avg(DrivAge) AS DrivAge,
         avg(BonusMalus) AS BonusMalus, avg(Density) AS Density
  FROM policies GROUP BY 1) g
UNPIVOT (mean FOR variable IN (Exposure, VehPower, VehAge, DrivAge, BonusMalus, Density))""")
def q_class_means(spark, sf):
    m = prof.class_means(policies(spark, sf), src.CONTINUOUS)
    return m.select("claim_class", "variable", r6("mean").alias("mean"), r6("ratio_to_none").alias("ratio_to_none"))


@query("f13_class_imbalance", O.POLICIES + """
SELECT CAST(count(CASE WHEN ClaimNb = 0 THEN 1 END) AS BIGINT) AS n_zero,
       CAST(count(CASE WHEN ClaimNb > 0 THEN 1 END) AS BIGINT) AS n_positive,
       round(CASE WHEN count(CASE WHEN ClaimNb > 0 THEN 1 END) = 0 THEN 1e0 ELSE
             count(CASE WHEN ClaimNb = 0 THEN 1 END) * 1e0 / count(CASE WHEN ClaimNb > 0 THEN 1 END) END, 9)
         AS scale_pos_weight FROM policies""")
def q_imbalance(spark, sf):
    return prof.imbalance(policies(spark, sf)).withColumn("scale_pos_weight", F.round("scale_pos_weight", 9))


@query("f18_category_counts", O.FEATURES + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count "
    f"FROM features GROUP BY {c}" for c in src.CATEGORICAL))
def q_category_counts(spark, sf):
    return prof.category_counts(features(spark, sf), src.CATEGORICAL)


RELATIVITY_SEGMENTS_SQL = {
    "bonus_malus_above_100": "BonusMalus > 100",
    "young_driver_high_power": "DrivAge < 25 AND VehPower > 8",
    "experience_below_3": "DrivExperience < 3",
    "power_above_10": "VehPower > 10",
    "vehicle_age_0_2": "VehAge <= 2",
    "density_above_1000": "Density > 1000",
    "exposure_below_0_1": "Exposure < CAST(0.1 AS DOUBLE)",
}


@query("f23_relativities", O.FEATURES + " UNION ALL ".join(
    f"SELECT '{k}' AS segment, CAST(count(CASE WHEN {v} THEN 1 END) AS BIGINT) AS policies, "
    f"round(sum(CASE WHEN {v} THEN ClaimNb ELSE 0 END) / sum(CASE WHEN {v} THEN Exposure ELSE 0 END), 6) AS freq_in, "
    f"round(sum(CASE WHEN NOT ({v}) THEN ClaimNb ELSE 0 END) / sum(CASE WHEN NOT ({v}) THEN Exposure ELSE 0 END), 6)"
    f" AS freq_out, round((sum(CASE WHEN {v} THEN ClaimNb ELSE 0 END) / sum(CASE WHEN {v} THEN Exposure ELSE 0 END))"
    f" / (sum(CASE WHEN NOT ({v}) THEN ClaimNb ELSE 0 END) / sum(CASE WHEN NOT ({v}) THEN Exposure ELSE 0 END)), 6)"
    f" AS relativity FROM features" for k, v in RELATIVITY_SEGMENTS_SQL.items()))
def q_relativities(spark, sf):
    segs = {k: F.expr(v) for k, v in RELATIVITY_SEGMENTS_SQL.items()}
    r = prof.relativities(features(spark, sf), segs)
    return r.select("segment", "policies", r6("freq_in").alias("freq_in"), r6("freq_out").alias("freq_out"),
                    r6("relativity").alias("relativity"))
