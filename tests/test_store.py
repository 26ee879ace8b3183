"""Shared fits, the state bundle's checks and the alignment gate."""
import json

import pytest
from pyspark.sql import functions as F

from claimwise.operators import boost as bst
from claimwise.operators import evaluate as ev
from claimwise.operators import features as feat
from claimwise.operators import glm, store
from claimwise.operators import target as tg
from claimwise.sources import tables as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    pol = src.policies(spark, SF)
    fe, state = feat.engineer(pol)
    train, _ = tg.split(glm.model_frame(fe))
    cols = ["BonusMalus", "DrivAge", "VehPower", "RiskSegment"]
    return pol, store.Bundle(pol.schema, state, {"boosted": bst.fit_boosted(train, "boosted", cols, bst.BoostParams(rounds=3))})


def test_bundle_round_trip_and_checks(spark, fitted, tmp_path):
    pol, bundle = fitted
    path = str(tmp_path / "bundle")
    bundle.save(path)
    back = store.load_bundle(spark.newSession(), path)
    one, two = ({r["IDpol"]: r["predicted"] for r in b.score(pol).collect()} for b in (bundle, back))
    assert one == two and len(one) == 1500
    extra = pol.withColumn("more", F.lit(1))
    assert back.score(extra).count() == 1500
    with pytest.raises(ValueError, match="missing Region"):
        back.score(pol.drop("Region"))
    with pytest.raises(ValueError, match="VehPower is string"):
        back.score(pol.withColumn("VehPower", F.col("VehPower").cast("string")))
    back.models["boosted"].feature_cols.append("Nowhere")
    with pytest.raises(ValueError, match="Nowhere"):
        back.score(pol)
    meta = json.loads(spark.read.text(f"{path}/bundle").first()[0])
    spark.createDataFrame([(json.dumps(meta | {"version": 99}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")
    with pytest.raises(ValueError, match="version 99"):
        store.load_bundle(spark, path)


def test_fits_are_shared_by_content(spark):
    class Fit:
        def __init__(self, text):
            self.text = text

        def save(self, path):
            store._write_text(self.text, f"{path}/x")

    def fit():
        calls.append(1)
        return {"a": Fit("one"), "b": Fit("two")}

    calls = []
    load = lambda path: Fit(spark.read.text(f"{path}/x").first()[0])
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    key = store.content_key(df, ["v"])
    assert key == store.content_key(df.repartition(7), ["v"]) != store.content_key(df.where("id < 99"), ["v"])
    assert key != store.content_key(df, ["id"]) and key != store.content_key(df.withColumnRenamed("v", "w"), ["v"])
    for _ in range(3):
        got = store.stored(spark, "test", key, ["a", "b"], fit, load)
        assert {n: f.text for n, f in got.items()} == {"a": "one", "b": "two"}
    assert len(calls) == 1


def test_alignment_gate(spark):
    a = spark.createDataFrame([(i,) for i in [1, 2, 3, 3, None]], "IDpol long")
    p = spark.createDataFrame([(i,) for i in [2, 3, 5, 6, 6]], "IDpol long")
    with pytest.raises(ev.Misaligned) as e:
        ev.require_aligned(a, p, listed=1)
    report = {r["side"]: (r["n"], r["first_keys"]) for r in e.value.report}
    assert report == {"missing_prediction": (2, [1]), "missing_actual": (2, [5]), "repeated_actual": (1, [3]), "repeated_prediction": (1, [6])}
    ev.require_aligned(a.where("IDpol > 0").distinct(), a.where("IDpol > 0").distinct())
    ev.require_aligned(a.limit(0), a.limit(0))


def test_models_of_a_fit_are_stored_each(spark):
    """A query that needs one model fits that one; who needs more later fits the rest only."""
    frame = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(60)], "IDpol long, ClaimNb double, a double")
    asked = []

    def fit(missing):
        asked.append(missing)
        return bst.fit_models(frame, ["a"], {m: bst.ModelSpec(bst.BoostParams(rounds=1), None) for m in missing})
    rows = store.content_key(frame, ["a"])
    get = lambda names: store.stored_each(spark, "each-test", {m: store.settings_key(rows, m) for m in names}, fit, bst.BoostedModel.load)
    one = get(["one"])["one"]
    both = get(["one", "two"])
    assert asked == [["one"], ["two"]] and list(both) == ["one", "two"] and both["one"].name == "one" and both["one"].base == one.base
    assert get(["two", "one"]).keys() == both.keys() and len(asked) == 2
