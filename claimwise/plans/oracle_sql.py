"""DuckDB text of the shared inputs (policies, scored, features) used as CTEs
by the per-query oracle statements in ``catalog.py``."""

from ..sources.tables import POLICIES_SQL, SCORED_SQL

FEATURES_SQL = """
codes AS (
  SELECT 'Area' AS column_name, v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code
    FROM (SELECT DISTINCT Area AS v FROM policies) t
  UNION ALL SELECT 'VehBrand', v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT)
    FROM (SELECT DISTINCT VehBrand AS v FROM policies) t
  UNION ALL SELECT 'VehGas', v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT)
    FROM (SELECT DISTINCT VehGas AS v FROM policies) t
  UNION ALL SELECT 'Region', v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT)
    FROM (SELECT DISTINCT Region AS v FROM policies) t),
enc AS (
  SELECT p.IDpol, p.ClaimNb, p.Exposure, a.code AS Area, p.VehPower, p.VehAge, p.DrivAge, p.BonusMalus,
         b.code AS VehBrand, g.code AS VehGas, p.Density, r.code AS Region
  FROM policies p
  LEFT JOIN codes a ON a.column_name = 'Area' AND a.value = p.Area
  LEFT JOIN codes b ON b.column_name = 'VehBrand' AND b.value = p.VehBrand
  LEFT JOIN codes g ON g.column_name = 'VehGas' AND g.value = p.VehGas
  LEFT JOIN codes r ON r.column_name = 'Region' AND r.value = p.Region),
base AS (
  SELECT *, CAST(Exposure < 5e-2 AS INT) AS VeryShortExposure, ln(1 + Density) AS LogDensity,
         CAST(CASE WHEN Density IS NULL OR Density <= 0 THEN NULL WHEN Density <= 50 THEN 0
              WHEN Density <= 200 THEN 1 WHEN Density <= 500 THEN 2 WHEN Density <= 1000 THEN 3
              WHEN Density <= 5000 THEN 4 ELSE 5 END AS INT) AS DensityGroup
  FROM enc),
filled AS (
  SELECT IDpol, ClaimNb, Exposure, Area,
         coalesce(CAST(VehPower AS DOUBLE), (SELECT median(VehPower) FROM base)) AS VehPower,
         coalesce(CAST(VehAge AS DOUBLE), (SELECT median(VehAge) FROM base)) AS VehAge,
         DrivAge, BonusMalus, VehBrand, VehGas, Density, Region, VeryShortExposure, LogDensity, DensityGroup
  FROM base),
th AS (SELECT avg(Density) AS mean_density, quantile_cont(Density, 0.9) AS q90_density FROM filled),
f1 AS (
  SELECT f.*, th.mean_density, th.q90_density,
         ln(1 + Exposure) AS LogExposure,
         VehAge / greatest(DrivAge, 1) AS VehAge_DrivAge_Ratio,
         CAST(VehAge <= 1 AS INT) AS NewVehicle,
         CAST(VehAge > 1 AND VehAge <= 3 AS INT) AS YoungVehicle,
         CAST(VehAge > 3 AND VehAge <= 10 AS INT) AS MatureVehicle,
         CAST(VehAge > 10 AS INT) AS OldVehicle,
         CAST(VehAge > 15 AS INT) AS VeryOldVehicle,
         CAST(DrivAge >= 18 AND DrivAge < 21 AS INT) AS TeenDriver,
         CAST(DrivAge >= 21 AND DrivAge < 25 AS INT) AS YoungDriver,
         CAST(DrivAge >= 25 AND DrivAge < 65 AS INT) AS AdultDriver,
         CAST(DrivAge >= 65 AS INT) AS SeniorDriver,
         greatest(DrivAge - 18, 0) AS DrivExperience
  FROM filled f CROSS JOIN th),
f2 AS (
  SELECT *,
         CAST(DrivExperience <= 1 AS INT) AS VeryNoviceDriver,
         CAST(DrivExperience > 1 AND DrivExperience <= 3 AS INT) AS NoviceDriver,
         CAST(DrivExperience > 3 AND DrivExperience <= 10 AS INT) AS ModerateExperienceDriver,
         CAST(DrivExperience > 10 AS INT) AS ExperiencedDriver,
         VehPower / greatest(DrivExperience, 1) AS PowerToExperience,
         CAST(VehPower <= 5 AS INT) AS LowPower,
         CAST(VehPower > 5 AND VehPower <= 8 AS INT) AS MediumPower,
         CAST(VehPower > 8 AND VehPower <= 10 AS INT) AS HighPower,
         CAST(VehPower > 10 AS INT) AS VeryHighPower,
         CAST(DrivAge < 25 AND VehPower > 8 AS INT) AS YoungDriverHighPower,
         CAST(DrivExperience <= 3 AND VehAge <= 3 AS INT) AS NewDriverNewCar,
         VehPower / greatest(DrivExperience, 1) AS InexperiencePowerRatio,
         exp((BonusMalus - 50) / 50) AS BM_Exp,
         BonusMalus * VehPower AS BM_Power,
         BonusMalus / greatest(DrivAge, 1) AS BM_Age,
         CAST(BonusMalus > 100 AS INT) AS HighRiskBM,
         CAST(BonusMalus > 50 AND BonusMalus <= 100 AS INT) AS ModerateRiskBM,
         CAST(BonusMalus = 50 AS INT) AS LowRiskBM,
         CASE WHEN BonusMalus IS NULL OR BonusMalus <= 0 THEN NULL WHEN BonusMalus <= 50 THEN 'Base (50)'
              WHEN BonusMalus <= 75 THEN 'Moderate (51-75)' WHEN BonusMalus <= 100 THEN 'High (76-100)'
              ELSE 'Very High (>100)' END AS BM_Segment,
         CAST(Density > mean_density AND BonusMalus > 75 AS INT) AS HighDensityBM
  FROM f1),
f3 AS (
  SELECT *,
         CAST(3 * VeryHighPower + 5 * YoungDriverHighPower + 4 * HighRiskBM + 3 * TeenDriver
              + 2 * VeryOldVehicle + 4 * VeryShortExposure + 2 * CAST(Density > q90_density AS INT) AS INT)
           AS CompositeRiskScore
  FROM f2),
features AS (
  SELECT IDpol, ClaimNb, Exposure, Area, VehPower, VehAge, DrivAge, BonusMalus, VehBrand, VehGas, Density,
         Region, VeryShortExposure, LogDensity, DensityGroup, LogExposure, VehAge_DrivAge_Ratio, NewVehicle,
         YoungVehicle, MatureVehicle, OldVehicle, VeryOldVehicle, TeenDriver, YoungDriver, AdultDriver,
         SeniorDriver, DrivExperience, VeryNoviceDriver, NoviceDriver, ModerateExperienceDriver,
         ExperiencedDriver, PowerToExperience, LowPower, MediumPower, HighPower, VeryHighPower,
         YoungDriverHighPower, NewDriverNewCar, InexperiencePowerRatio, BM_Exp, BM_Power, BM_Age, HighRiskBM,
         ModerateRiskBM, LowRiskBM, BM_Segment, HighDensityBM, CompositeRiskScore,
         CASE WHEN CompositeRiskScore >= 4 THEN 'High' WHEN CompositeRiskScore = 0 THEN 'Low'
              ELSE 'Medium' END AS RiskSegment,
         VehPower * BonusMalus / greatest(DrivAge, 1) AS RiskFactorScore,
         Area * Region AS Area_Region, VehBrand * VehGas AS Brand_Gas, VehAge * VehPower AS VehAgePower
  FROM f3)"""


def features_sql(impute: str = "median", variant: str = "module") -> str:
    """FEATURES_SQL for the notebook variants: mean fill and/or DrivAge + 1."""
    out = FEATURES_SQL
    if impute == "mean":
        out = out.replace("(SELECT median(VehPower) FROM base)", "(SELECT avg(VehPower) FROM base)") \
                 .replace("(SELECT median(VehAge) FROM base)", "(SELECT avg(VehAge) FROM base)")
    if variant == "notebook":
        out = out.replace("VehPower * BonusMalus / greatest(DrivAge, 1) AS RiskFactorScore",
                          "VehPower * BonusMalus / (DrivAge + 1) AS RiskFactorScore")
    return out


def with_ctes(*parts: str) -> str:
    """``WITH`` clause from CTE fragments (each 'name AS (...)', comma-joined)."""
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"


POLICIES = with_ctes(POLICIES_SQL)
SCORED = with_ctes(POLICIES_SQL, SCORED_SQL)
FEATURES = with_ctes(POLICIES_SQL, FEATURES_SQL)
FEATURES_SCORED = with_ctes(POLICIES_SQL, FEATURES_SQL, SCORED_SQL)
