"""Fitted state applied to a stream; sinks write and read back."""
from pyspark.sql import functions as F

from claimwise.operators import evaluate as ev
from claimwise.operators import features as feat
from claimwise.operators import glm
from claimwise.sources import sinks
from claimwise.sources import tables as src
from claimwise.streaming.scoring import read_policy_stream, score_stream

SF = "/root/testdata/sf0.001"


def test_stream_scoring_matches_batch(spark, tmp_path):
    pol = src.policies(spark, SF)
    fe, state = feat.engineer(pol)
    mf = glm.model_frame(fe)
    model = glm.fit_glm(mf, "poisson", feature_cols=feat.model_columns(mf))
    inp = str(tmp_path / "in")
    src.conform(pol).repartition(3).write.parquet(inp)
    stream = read_policy_stream(spark, inp, max_files=1)
    q = score_stream(stream, state, model).writeStream.format("memory").queryName("scored_stream") \
        .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["IDpol"]: r["predicted"] for r in spark.table("scored_stream").collect()}
    batch = {r["IDpol"]: r["predicted"] for r in model.predict(mf).collect()}
    assert len(got) == len(batch) == 1500
    assert all(abs(got[k] - batch[k]) < 1e-12 for k in batch)


def test_sinks_roundtrip(spark, tmp_path):
    long = src.long_scores(src.scored(spark, SF))
    m = ev.metric_rows(long)
    summary = sinks.summary_table(m, None, ev.KEY_METRICS)
    sinks.write_summary(summary, str(tmp_path / "summary"))
    back = spark.read.parquet(str(tmp_path / "summary"))
    assert back.count() == 3 * len(ev.KEY_METRICS)
    top = ev.top_errors(long, 10, models=src.MODELS)
    sinks.write_csv(top, str(tmp_path / "top"), single_file=True)
    csv = spark.read.option("header", True).csv(str(tmp_path / "top"))
    assert csv.count() == 30 and set(csv.columns) >= {"model", "IDpol", "abs_error"}


def test_full_study_writes_every_table(spark, tmp_path):
    from claimwise.plans import study
    out = str(tmp_path / "study")
    metrics = study.run(spark, src.policies(spark, SF), out)
    assert set(metrics) == {"standard", "poisson", "tweedie"}
    for name in ("features", "shape", "null_profile", "inf_profile", "preview", "describe", "distinct_counts", "claim_counts", "imbalance", "relativities",
                 "risk_segment_shares", "claims_by_category", "metrics", "best_model", "risk_group_metrics", "error_frame", "prediction_ranges", "positive_rate",
                 "lift", "pr_curve", "comparison", "importance", "summary", "histograms", "error_kde", "best_model_top_errors"):
        assert spark.read.parquet(f"{out}/{name}").count() > 0, name
    assert len(spark.read.parquet(f"{out}/best_model_top_errors").columns) == 5 + 52
    assert spark.read.parquet(f"{out}/summary").where("section = 'top_features'").count() == 30
    # the bundle scores raw policies in another session as the study did
    from claimwise.operators import store
    test_ids = spark.read.parquet(f"{out}/scores")
    again = store.load_bundle(spark.newSession(), f"{out}/bundle").score(src.policies(spark, SF))
    joined = test_ids.join(again.withColumnRenamed("predicted", "later").drop("actual"), ["model", "IDpol"])
    assert joined.count() == test_ids.count() and joined.where("predicted <> later").count() == 0
    assert spark.read.option("header", True).csv(f"{out}/top_errors").count() == 30
    assert all(0.0 <= m["f1"] <= 1.0 for m in metrics.values())
