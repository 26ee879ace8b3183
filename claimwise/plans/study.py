"""The whole claims-frequency study as one call: load, clean
and derive features, profile tables, split, fit the three frequency models,
evaluate them, rank-based diagnostics, comparison, error analysis and the
summary, every result written as a table under ``out_dir``.

    python -m claimwise.plans.study --csv policies.csv --out /shared/study
    python -m claimwise.plans.study --tables /root/testdata/sf0.01 --out /tmp/study

Every output is a distributed write; the driver only sees per-model scalars.
The fitted state goes to one bundle, which scores raw policies later (``store``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataclasses import replace

from ..operators import boost as bst
from ..operators import eda
from ..operators import evaluate as ev
from ..operators import features as feat
from ..operators import glm
from ..operators import profile as prof
from ..operators import ranking as rk
from ..operators import store
from ..operators import target as tg
from ..operators import tune
from ..session import materialize, parallelism, run_parallel
from ..sources import sinks
from ..sources import tables as src
from .catalog import ENGINEERED_NUMERIC, KEY_VARS
from .models import BOOST_SPECS, CV_ROUNDS, FOLDS, GLM_SPECS, STANDARD, TUNED
from .queries import CONTEXT

SEGMENTS = {"young_driver": "DrivAge < 25", "high_bonus_malus": "BonusMalus > 100", "old_vehicle": "VehAge > 15", "dense_area": "DensityGroup >= 4",
            "powerful": "VehPower > 10"}


def _write(df: DataFrame, out_dir: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")


def _write_all(out_dir: str, tables: dict) -> None:
    """Build and write independent tables from a small thread pool."""
    run_parallel({name: (lambda name=name, fn=fn: _write(fn(), out_dir, name)) for name, fn in tables.items()})


def run(spark: SparkSession, policies: DataFrame, out_dir: str, learner: str = "glm",
        boost_rounds: int | None = None, impute: str = "median", variant: str = "module",
        first_appearance: bool = False, validate: bool = False, grid: dict | None = None) -> dict:
    """Runs the study; returns the per-model metric rows (small) for display.

    ``variant`` / ``first_appearance``: the notebook's risk factor and codes by first appearance.
    ``validate``: 5-fold scores of the boosted standard model (J5); ``grid``: parameter values to
    search with the same folds (J3/J4). Stops with ``evaluate.Misaligned`` if a model's scores and
    the test rows do not hold the same keys."""
    out_dir = out_dir.rstrip("/")
    fe, state = feat.engineer(policies, impute=impute, variant=variant)
    fe = materialize(fe, "study-features", min_partitions=parallelism(spark))
    long_vars = eda.to_long(fe, src.CONTINUOUS)
    # profiles and distribution tables (A2-A5, F1-F23): independent jobs, submitted concurrently
    _write_all(out_dir, {
        "features": lambda: fe,
        "shape": lambda: prof.shape(policies),
        "null_profile": lambda: prof.null_profile(policies),
        "inf_profile": lambda: prof.inf_profile(policies),
        "preview": lambda: prof.preview(policies),
        "describe": lambda: prof.describe(fe, ["ClaimNb", *src.CONTINUOUS]),
        "distinct_counts": lambda: prof.distinct_counts(policies, src.CATEGORICAL),
        "claim_counts": lambda: prof.value_counts(fe, "ClaimNb"),
        "claim_shares": lambda: prof.claim_shares(fe),
        "imbalance": lambda: prof.imbalance(fe),
        "relativities": lambda: prof.relativities(fe, {n: F.expr(c) for n, c in SEGMENTS.items()}),
        "risk_segments": lambda: prof.segment_summary(fe, "RiskSegment"),
        "risk_segment_shares": lambda: prof.segment_share(fe, "RiskSegment"),
        "claims_by_bm_segment": lambda: prof.mean_by(fe, "BM_Segment"),
        "claims_by_category": lambda: prof.mean_by_categories(fe, src.CATEGORICAL),
        "category_counts": lambda: prof.category_counts(fe, src.CATEGORICAL),
        "correlation": lambda: prof.correlation_pairs(fe, KEY_VARS + ENGINEERED_NUMERIC),
        "claim_class_means": lambda: prof.class_means(fe, src.CONTINUOUS),
        "histograms": lambda: eda.histogram(long_vars, 30),
        "kde": lambda: eda.kde(long_vars),
        "box_by_claims": lambda: eda.box_stats(eda.to_long(fe.where("ClaimNb < 5"), src.CONTINUOUS, ids=["ClaimNb"]),
                                               ["variable", "ClaimNb"]),
    })
    # split and fit (J1, K, L); codes by first appearance are fitted on the training rows
    codes = feat.fit_codes(tg.split(fe)[0], ["RiskSegment"], order="first") if first_appearance else None
    mf = materialize(glm.model_frame(fe, codes), "study-model-frame", min_partitions=parallelism(spark))
    train, test = tg.split(mf)
    cols = feat.model_columns(mf)
    if learner == "glm":
        # the three fits are independent: submit them concurrently
        fitted = run_parallel({name: (lambda name=name, spec=spec: glm.fit_glm(train, name, feature_cols=cols, **spec))
                               for name, spec in GLM_SPECS.items()})
    else:
        # the three models grow together: one job per tree level for all
        fitted = bst.fit_models(train, cols, {n: replace(s, params=replace(s.params, rounds=boost_rounds or s.params.rounds))
                                              for n, s in BOOST_SPECS.items()})
    if first_appearance:
        for name, model in fitted.items():
            model.save(f"{out_dir}/models/{name}")
    else:
        # everything that scoring raw policies later needs
        store.Bundle(policies.schema, state, fitted).save(f"{out_dir}/bundle")
    names = list(fitted)
    scores, importance = None, None
    for name, model in fitted.items():
        s = model.predict(test).withColumn("model", F.lit(name))
        scores = s if scores is None else scores.unionByName(s)
        imp = model.importance()
        importance = imp if importance is None else importance.unionByName(imp)
    scores = materialize(scores.select("model", "IDpol", "actual", "predicted"), "study-scores")
    for name in names:       # M1: by key, before anything is evaluated
        ev.require_aligned(test.select("IDpol"), scores.where(F.col("model") == name).select("IDpol"))
    metrics = materialize(ev.metric_rows(scores), "study-metrics")
    best = metrics.transform(ev.best_model).first()["model"]       # one row
    err = scores.select(F.col("model").alias("variable"), (F.col("actual") - F.col("predicted")).alias("value"))
    wide = test.select("IDpol", F.col("ClaimNb").alias("actual"))
    for name in names:
        wide = wide.join(scores.where(F.col("model") == name).select("IDpol", F.col("predicted").alias(f"predicted_{name}")), "IDpol")
    # evaluation (M), ranking (G), diagnostics (F19-F22), importance (H1): concurrent writes
    _write_all(out_dir, {
        "scores": lambda: scores,
        "metrics": lambda: metrics,
        "best_model": lambda: ev.best_model(metrics),
        "class_metrics": lambda: ev.class_metrics(scores),
        "notebook_metrics": lambda: ev.notebook_metrics(scores),
        "risk_group_metrics": lambda: ev.notebook_risk_groups(scores),
        "comparison": lambda: ev.key_comparison(metrics, names),
        "error_frame": lambda: ev.error_frame(wide, fe, names, context_cols=CONTEXT),
        "prediction_ranges": lambda: eda.ranges(scores),
        "positive_rate": lambda: eda.positive_rate(scores),
        "lift": lambda: rk.lift_table(scores),
        "pr_curve": lambda: rk.pr_curve(scores),
        "pr_summary": lambda: rk.pr_summary(scores),
        "error_histograms": lambda: eda.histogram(err.where(F.abs("value") < 2), 50),
        "error_kde": lambda: eda.kde(err.where(F.abs("value") < 2)),
        "actual_vs_predicted": lambda: eda.scatter_density(scores),
        "importance": lambda: glm.ranked_importance(importance),
        "best_model_top_errors": lambda: ev.best_model_errors(scores, best, fe, 10),
        **({"cv_scores": lambda: tune.boosted_cv(train, cols, replace(STANDARD, rounds=boost_rounds or CV_ROUNDS, positive_weight=1.0), FOLDS)} if validate else {}),
        **({"grid": lambda: tune.grid_summary(tune.boosted_grid(train, cols, grid, replace(STANDARD, rounds=boost_rounds or CV_ROUNDS, positive_weight=1.0), FOLDS))} if grid else {}),
    })
    top = ev.top_errors(scores, 10, models=names)
    # broadcast bound: 10 rows per model
    top = F.broadcast(top)
    sinks.write_csv(top.join(fe.select("IDpol", *CONTEXT), "IDpol"), f"{out_dir}/top_errors", single_file=True)
    sinks.write_summary(sinks.summary_table(metrics, importance, ev.KEY_METRICS), f"{out_dir}/summary")
    return {r["model"]: r.asDict() for r in metrics.collect()}


def main(argv=None):
    ap = argparse.ArgumentParser(description="claims-frequency study on Spark")
    src_arg = ap.add_mutually_exclusive_group(required=True)
    src_arg.add_argument("--csv", help="policy CSV with a header (fixed schema)")
    src_arg.add_argument("--tables", help="folder with the TPC-H-style parquet tables")
    ap.add_argument("--out", required=True)
    ap.add_argument("--learner", choices=["glm", "boosted"], default="glm")
    ap.add_argument("--rounds", type=int, default=None)
    ap.add_argument("--impute", choices=["median", "mean"], default="median")
    ap.add_argument("--variant", choices=["module", "notebook"], default="module")
    ap.add_argument("--first-appearance", action="store_true", help="RiskSegment codes by first appearance")
    ap.add_argument("--validate", action="store_true", help="5-fold scores of the boosted standard model")
    ap.add_argument("--grid", action="store_true", help="search all values of the six tuned parameters")
    a = ap.parse_args(argv)
    from ..session import build_session
    spark = build_session()
    pol = src.read_policies_csv(spark, a.csv) if a.csv else src.policies(spark, a.tables)
    for m, row in run(spark, pol, a.out, a.learner, a.rounds, a.impute, a.variant, a.first_appearance, a.validate,
                       TUNED if a.grid else None).items():
        print(m, {k: round(v, 4) for k, v in row.items() if isinstance(v, float)})


if __name__ == "__main__":
    main()
