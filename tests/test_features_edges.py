"""Boundary rows on each side of every bin / flag edge (FIXTURES §4)."""
import math

from pyspark.sql import functions as F

from claimwise.operators import features as feat
from claimwise.sources.tables import POLICY_SCHEMA


def _policies(spark, rows):
    base = dict(IDpol=1, ClaimNb=0, Exposure=0.5, Area="A", VehPower=6, VehAge=5, DrivAge=40, BonusMalus=50,
                VehBrand="B1", VehGas="Regular", Density=100.0, Region="R1")
    out = []
    for i, r in enumerate(rows):
        d = dict(base, IDpol=i + 1, **r)
        out.append(tuple(d[f.name] for f in POLICY_SCHEMA.fields))
    return spark.createDataFrame(out, POLICY_SCHEMA)


def _derive(spark, rows, col):
    df = _policies(spark, rows)
    out = feat.derive(feat.base_columns(feat.apply_codes(df, feat.fit_codes(df))),
                      feat.DensityThresholds(1e9, 1e9))
    return [r[col] for r in out.orderBy("IDpol").collect()]


def test_exposure_flag(spark):
    vals = [0.049, 0.05, 0.051, 1.0]
    got = _derive(spark, [{"Exposure": v} for v in vals], "VeryShortExposure")
    assert got == [1, 0, 0, 0]


def test_density_group_right_closed(spark):
    vals = [0.0, 1.0, 50.0, 50.5, 200.0, 201.0, 500.0, 501.0, 1000.0, 1001.0, 5000.0, 5001.0]
    got = _derive(spark, [{"Density": v} for v in vals], "DensityGroup")
    assert got == [None, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_vehicle_age_flags_partition(spark):
    vals = [0, 1, 2, 3, 4, 10, 11, 15, 16]
    df = _policies(spark, [{"VehAge": v} for v in vals])
    out = feat.derive(feat.base_columns(feat.apply_codes(df, feat.fit_codes(df))), feat.DensityThresholds(1e9, 1e9))
    rows = out.orderBy("IDpol").collect()
    for r in rows:
        assert r["NewVehicle"] + r["YoungVehicle"] + r["MatureVehicle"] + r["OldVehicle"] == 1
    assert [r["VeryOldVehicle"] for r in rows] == [0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert [r["NewVehicle"] for r in rows] == [1, 1, 0, 0, 0, 0, 0, 0, 0]


def test_driver_age_and_experience(spark):
    vals = [17, 18, 19, 20, 21, 24, 25, 64, 65]
    df = _policies(spark, [{"DrivAge": v} for v in vals])
    out = feat.derive(feat.base_columns(feat.apply_codes(df, feat.fit_codes(df))), feat.DensityThresholds(1e9, 1e9))
    rows = out.orderBy("IDpol").collect()
    assert [r["TeenDriver"] for r in rows] == [0, 1, 1, 1, 0, 0, 0, 0, 0]
    assert [r["SeniorDriver"] for r in rows] == [0, 0, 0, 0, 0, 0, 0, 0, 1]
    # under 18: no age flag at all
    r17 = rows[0]
    assert r17["TeenDriver"] + r17["YoungDriver"] + r17["AdultDriver"] + r17["SeniorDriver"] == 0
    assert [r["DrivExperience"] for r in rows] == [0, 0, 1, 2, 3, 6, 7, 46, 47]
    for r in rows:
        assert r["VeryNoviceDriver"] + r["NoviceDriver"] + r["ModerateExperienceDriver"] + r["ExperiencedDriver"] == 1
        assert r["PowerToExperience"] == r["InexperiencePowerRatio"]


def test_power_and_bonus_malus(spark):
    got = _derive(spark, [{"VehPower": v} for v in [5, 6, 8, 9, 10, 11]], "VeryHighPower")
    assert got == [0, 0, 0, 0, 0, 1]
    bms = [49, 50, 51, 75, 76, 100, 101, 350]
    df = _policies(spark, [{"BonusMalus": v} for v in bms])
    rows = feat.derive(feat.base_columns(feat.apply_codes(df, feat.fit_codes(df))),
                       feat.DensityThresholds(1e9, 1e9)).orderBy("IDpol").collect()
    assert [r["LowRiskBM"] for r in rows] == [0, 1, 0, 0, 0, 0, 0, 0]
    assert [r["HighRiskBM"] for r in rows] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert [r["BM_Segment"] for r in rows] == ["Base (50)", "Base (50)", "Moderate (51-75)", "Moderate (51-75)",
                                               "High (76-100)", "High (76-100)", "Very High (>100)",
                                               "Very High (>100)"]
    assert math.isclose(rows[1]["BM_Exp"], 1.0)


def test_composite_score_segments(spark):
    # score 0 -> Low, 3 (teen) -> Medium, 4 (short exposure) -> High
    df = _policies(spark, [{}, {"DrivAge": 19}, {"Exposure": 0.01}, {"DrivAge": 19, "VehPower": 11, "VehAge": 16}])
    rows = feat.derive(feat.base_columns(feat.apply_codes(df, feat.fit_codes(df))),
                       feat.DensityThresholds(1e9, 1e9)).orderBy("IDpol").collect()
    assert [r["CompositeRiskScore"] for r in rows] == [0, 3, 4, 3 + 3 + 5 + 2]
    assert [r["RiskSegment"] for r in rows] == ["Low", "Medium", "High", "High"]


def test_cleaning_non_finite_and_nulls(spark):
    df = _policies(spark, [{"Exposure": float("inf")}, {"Exposure": float("-inf")}, {"Exposure": float("nan")},
                           {"Exposure": None}, {"Exposure": 0.2}, {"Exposure": 0.4}, {"VehPower": None}])
    cleaned, state = feat.clean(df)
    got = [r["Exposure"] for r in cleaned.orderBy("IDpol").collect()]
    # four blanks filled with the median of the remaining finite values (0.2, 0.4, 0.5)
    assert got[:4] == [0.4] * 4 and got[4:6] == [0.2, 0.4]
    assert state.fills["Exposure"] == 0.4
    assert state.fills["VehPower"] == 6.0


def test_label_codes_sorted_and_first_appearance(spark):
    df = _policies(spark, [{"Area": "C"}, {"Area": "A"}, {"Area": "B"}, {"Area": "A"}])
    codes = {r["value"]: r["code"] for r in feat.fit_codes(df, ["Area"]).collect()}
    assert codes == {"A": 0, "B": 1, "C": 2}
    first = {r["value"]: r["code"] for r in feat.fit_codes(df, ["Area"], order="first").collect()}
    assert first == {"C": 0, "A": 1, "B": 2}
    # the distributed path gives the same codes
    big = {r["value"]: r["code"] for r in feat.fit_codes(df, ["Area"], vocab_estimate=10**9).collect()}
    assert big == codes


def test_segment_codes(spark):
    df = spark.createDataFrame([("Base (50)", "High"), ("Very High (>100)", "Medium"), (None, "Low"), ("x", "y")],
                               "BM_Segment string, RiskSegment string")
    got = [(r["BM_Segment"], r["RiskSegment"]) for r in feat.segment_codes(df).collect()]
    assert got == [(0, 0), (3, 2), (-1, 1), (-1, -1)]


def test_unseen_category_gets_minus_one(spark):
    fit = _policies(spark, [{"Area": "A"}, {"Area": "B"}])
    codes = feat.fit_codes(fit, ["Area"])
    new = _policies(spark, [{"Area": "B"}, {"Area": "Z"}])
    got = [r["Area"] for r in feat.apply_codes(new, codes, ["Area"]).orderBy("IDpol").collect()]
    assert got == [1, -1]
