"""Model properties: GLM count+offset balance, boosting lowers deviance,
save/load round trip, split stability, CV output shape."""
import math

import pytest
from pyspark.sql import functions as F

from claimwise.operators import boost as bst
from claimwise.operators import features as feat
from claimwise.operators import glm
from claimwise.operators import target as tg
from claimwise.sources import tables as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    fe, _ = feat.engineer(src.policies(spark, SF))
    mf = glm.model_frame(fe).persist()
    return mf, feat.model_columns(mf)


def test_glm_balance_property(spark, frame):
    mf, cols = frame
    m = glm.fit_glm(mf, "poisson", feature_cols=cols, mode="actuarial", reg_param=0.0, max_iter=100)
    # with an intercept and the offset, fitted means sum to observed claims
    s = m.pipeline.transform(m.prep.transform(mf)).agg(F.sum("prediction"), F.sum("ClaimNb")).first()
    assert math.isclose(s[0], s[1], rel_tol=1e-4)


def test_glm_predictions_and_save_load(spark, frame, tmp_path):
    mf, cols = frame
    train, test = tg.split(mf)
    m = glm.fit_glm(train, "tweedie", family="tweedie", feature_cols=cols)
    p1 = {r["IDpol"]: r["predicted"] for r in m.predict(test).collect()}
    assert all(v >= 0 for v in p1.values())
    path = str(tmp_path / "tweedie")
    m.save(path)
    m2 = glm.load_glm(path, "tweedie", m.prep, cols, nonnegative=True)
    p2 = {r["IDpol"]: r["predicted"] for r in m2.predict(test).collect()}
    assert p1 == p2
    imp = m.importance().toPandas()
    assert len(imp) == len(cols) and math.isclose(imp["importance"].sum(), 1.0)


def test_boosting_lowers_training_deviance(spark, frame):
    mf, cols = frame
    p = bst.BoostParams(objective="poisson", rounds=4, learning_rate=0.3)
    m = bst.fit_boosted(mf, "poisson", cols, p, track_deviance=True)
    h = m.history
    assert all(b < a for a, b in zip(h, h[1:])), h
    assert m.predict(mf).where(F.col("predicted") < 0).count() == 0
    imp = m.importance().toPandas()
    assert math.isclose(imp["importance"].sum(), 1.0)


def test_split_is_stable_and_disjoint(spark):
    pol = src.policies(spark, SF)
    a = {r["IDpol"]: r["s"] for r in pol.select("IDpol", tg.split_column().alias("s")).collect()}
    b = {r["IDpol"]: r["s"] for r in pol.repartition(7).select("IDpol", tg.split_column().alias("s")).collect()}
    assert a == b
    share = sum(1 for v in a.values() if v == "test") / len(a)
    assert 0.15 < share < 0.25


def test_target_prep_modes(spark):
    df = spark.createDataFrame([(1, 0, 0.01), (2, 1, 0.5), (3, 2, 1.0), (4, 5, 0.02)],
                               "IDpol long, ClaimNb long, Exposure double")
    prep = tg.TargetPrep.fit(df)
    rows = {r["IDpol"]: r for r in prep.transform(df).collect()}
    assert rows[1]["exposure_adj"] == 0.05 and rows[1]["target"] == 1e-6
    assert math.isclose(rows[4]["frequency"], 100.0)
    assert rows[4]["target"] <= prep.cap
    none = tg.TargetPrep.fit(df, exposure_col=None)
    assert {r["target"] for r in none.transform(df).collect()} == {0.0, 1.0, 2.0, 5.0}


def test_boosted_save_load_roundtrip(spark, frame, tmp_path):
    mf, cols = frame
    m = bst.fit_boosted(mf, "poisson", cols, bst.BoostParams(objective="poisson", rounds=2))
    m.save(str(tmp_path / "b"))
    m2 = bst.BoostedModel.load(str(tmp_path / "b"))
    a = {r["IDpol"]: r["predicted"] for r in m.predict(mf).collect()}
    b = {r["IDpol"]: r["predicted"] for r in m2.predict(mf).collect()}
    assert a == b


def test_csv_source_with_fixed_schema(spark, tmp_path):
    pol = src.conform(src.policies(spark, SF))
    pol.write.option("header", True).csv(str(tmp_path / "csv"))
    back = src.read_policies_csv(spark, str(tmp_path / "csv"))
    assert src.check_schema(back) == []
    assert back.count() == 1500
    assert back.agg(F.sum("ClaimNb")).first()[0] == pol.agg(F.sum("ClaimNb")).first()[0]
    assert src.check_schema(pol.drop("Region")) == ["missing Region"]


def test_split_disjoint_and_complete(spark):
    pol = src.policies(spark, SF)
    train, test = tg.split(pol)
    a = {r["IDpol"] for r in train.select("IDpol").collect()}
    b = {r["IDpol"] for r in test.select("IDpol").collect()}
    assert not (a & b) and len(a | b) == pol.count()


def test_model_frame_first_appearance_codes(spark):
    fe, _ = feat.engineer(src.policies(spark, SF))
    first = feat.fit_codes(fe, ["RiskSegment"], order="first")
    mf = glm.model_frame(fe, first_appearance=first)
    assert mf.columns == glm.model_frame(fe).columns
    order = [r["RiskSegment"] for r in fe.groupBy("RiskSegment").agg(F.min("IDpol").alias("m")).orderBy("m").collect()]
    got = {r["IDpol"]: r["RiskSegment"] for r in mf.select("IDpol", "RiskSegment").collect()}
    seg = {r["IDpol"]: r["RiskSegment"] for r in fe.select("IDpol", "RiskSegment").collect()}
    assert all(got[k] == order.index(v) for k, v in seg.items())


def test_glms_read_vectors_written_once(spark, frame):
    """Passes of a fit read one staged table, shared by the models, and give the fit over the raw columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import GeneralizedLinearRegression
    mf, cols = frame
    scaled = glm.standardised(mf, cols, ["ClaimNb", "Exposure"])
    assert scaled.rows.columns == ["ClaimNb", "Exposure", "features"]
    plan = scaled.rows._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and all("glm-features" in f for f in scaled.rows.inputFiles())
    m = glm.fit_glm(mf, "poisson", feature_cols=cols, scaled=scaled)
    whole = Pipeline(stages=[glm.assembler(cols), StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True),
                             GeneralizedLinearRegression(family="poisson", link="log", labelCol="target", offsetCol="offset", regParam=1e-4, maxIter=50)])
    want = whole.fit(m.prep.transform(mf)).stages[-1]
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(m.glm.coefficients, want.coefficients))


def test_cleaning_and_describe_read_joins_once(spark, monkeypatch):
    from claimwise.operators import profile as prof
    written = []
    for module in (feat, prof):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label="stage", *a, real=real, **k: written.append(label) or real(df, label, *a, **k))
    pol = src.policies(spark, SF)
    cleaned, _ = feat.clean(pol)
    assert written[0] == "policies" and "orders.parquet" not in cleaned._jdf.queryExecution().optimizedPlan().toString()
    prof.describe(pol, ["Exposure"], max_buffered_distinct=0)
    assert written[-1] == "describe"
