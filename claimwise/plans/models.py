"""Registered model queries (L, J, H1/H3/H4, I1, A8, M1).

Fits are shared: a fit is saved under a key of its training rows and settings (``store``), and
every query that needs it reads it. Whole fits are not SQL-expressible and carry no oracle text;
what is, does: one boosting round of depth 1, CV of the intercept, the ranking of importances, the
evaluator, the bundle and the alignment gate."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bins
from ..operators import boost as bst
from ..operators import evaluate as ev
from ..operators import features as feat
from ..operators import glm, store
from ..operators import target as tg
from ..operators import tune
from ..session import materialize, parallelism, run_parallel, scratch_root
from ..sources import tables as src
from . import oracle_sql as O
from .catalog import query
from .queries import sql

GLM_SPECS = {
    "standard": dict(family="poisson", exposure_col=None),
    "poisson": dict(family="poisson", exposure_col="Exposure"),
    "tweedie": dict(family="tweedie", exposure_col="Exposure"),
}
# The standard model has learning rate 0.05, depth 5, lambda 0.1, positives weighted by
# zeros / positives, and 200 rounds; the Poisson and Tweedie models the BoostParams defaults and 300 rounds.
STANDARD = bst.BoostParams(learning_rate=0.05, max_depth=5, reg_lambda=0.1, rounds=200, positive_weight=None)
BOOST_SPECS = {
    "standard": bst.ModelSpec(STANDARD, None),
    "poisson": bst.ModelSpec(bst.BoostParams()),
    "tweedie": bst.ModelSpec(bst.BoostParams(objective="tweedie")),
}
# Six tuned parameters with their values, five folds, 100 rounds in cross-validation.
TUNED = {"learning_rate": [0.01, 0.05, 0.1], "max_depth": [3, 5, 7], "min_child_weight": [1, 3, 5], "subsample": [0.6, 0.8, 1.0],
         "colsample_bytree": [0.6, 0.8, 1.0], "gamma": [0, 0.1, 0.2]}
FOLDS, CV_ROUNDS = 5, 100
#: The grid query takes every value of the tuned parameters (729 combinations x 5 folds), each with the reference's rounds.
GRID_ROUNDS = 100


def model_data(spark, sf) -> tuple[DataFrame, DataFrame, list[str]]:
    """Feature table with segment codes, materialised once, split 80/20 by hash."""
    fe, _ = feat.engineer(src.policies(spark, sf))
    mf = materialize(glm.model_frame(fe), "model-frame", min_partitions=parallelism(spark))
    train, test = tg.split(mf)
    cols = feat.model_columns(mf)
    return train, test, cols


def fitted_glms(train: DataFrame, cols: list[str]) -> dict:
    """The three GLMs, fitted once for equal training rows, over the same standardised vectors."""
    spark = train.sparkSession

    def fit():
        scaled = glm.standardised(train, cols, ["ClaimNb", "Exposure"])
        return run_parallel({m: (lambda m=m, spec=spec: glm.fit_glm(train, m, feature_cols=cols, scaled=scaled, **spec)) for m, spec in GLM_SPECS.items()})
    return store.stored(spark, "glm", store.content_key(train, cols, GLM_SPECS), list(GLM_SPECS), fit, glm.FittedGLM.load)


def fitted_boosters(train: DataFrame, cols: list[str], names: list[str] | None = None) -> dict:
    """The boosted models ``names`` (all three) at their full rounds. Those that no earlier query has fitted are
    grown in one joint fit, over the same cut points whichever they are."""
    specs = {m: BOOST_SPECS[m] for m in names or BOOST_SPECS}
    max_bins = max(s.params.max_bins for s in BOOST_SPECS.values())
    rows = store.content_key(train, cols, max_bins)

    def fit(missing):
        return bst.fit_models(train, cols, {m: specs[m] for m in missing}, cuts=bins.fit_cuts(train, cols, max_bins))
    return store.stored_each(train.sparkSession, "boosted", {m: store.settings_key(rows, m, asdict(s)) for m, s in specs.items()}, fit, bst.BoostedModel.load)


def _stacked(models: dict, test: DataFrame) -> DataFrame:
    out = None
    for m, f in models.items():
        s = f.predict(test).withColumn("model", F.lit(m))
        out = s if out is None else out.unionByName(s)
    return out.select("model", "IDpol", "actual", "predicted")


def glm_scores(spark, sf) -> DataFrame:
    train, test, cols = model_data(spark, sf)
    return _stacked(fitted_glms(train, cols), test)


def _importance(models: dict) -> DataFrame:
    imp = None
    for f in models.values():
        imp = f.importance() if imp is None else imp.unionByName(f.importance())
    return imp


def _glm_importance(spark, sf) -> DataFrame:
    train, _, cols = model_data(spark, sf)
    return _importance(fitted_glms(train, cols))


@query("l01_glm_scores")
def q_glm_scores(spark, sf):
    """Three GLMs fitted on the train split, test set scored (long form)."""
    return glm_scores(spark, sf)


@query("l12_glm_metric_rows")
def q_glm_metrics(spark, sf):
    """M12 on real model scores (test split)."""
    return ev.metric_rows(glm_scores(spark, sf))


@query("l06_feature_importance")
def q_importance(spark, sf):
    """L6 + I1 + H1: importance of the three models stacked, ranked per model."""
    return glm.ranked_importance(_glm_importance(spark, sf))


@query("h03_top10_features")
def q_top10(spark, sf):
    return glm.ranked_importance(_glm_importance(spark, sf), 10)


@query("h04_top20_features")
def q_top20(spark, sf):
    """H4: the 20 most important features per model."""
    return glm.ranked_importance(_glm_importance(spark, sf), 20)


def _boosted_scores(spark, sf, name: str) -> DataFrame:
    train, test, cols = model_data(spark, sf)
    return fitted_boosters(train, cols, [name])[name].predict(test)


@query("l09_boosted_standard_scores")
def q_boosted_standard(spark, sf):
    """L1 as boosted trees, 200 rounds: count target, no exposure offset, weighted positives."""
    return _boosted_scores(spark, sf, "standard")


@query("l10_boosted_poisson_scores")
def q_boosted(spark, sf):
    """L2 as boosted trees, 300 rounds."""
    return _boosted_scores(spark, sf, "poisson")


@query("l11_boosted_tweedie_scores")
def q_boosted_tweedie(spark, sf):
    """L3 as boosted trees, 300 rounds."""
    return _boosted_scores(spark, sf, "tweedie")


@query("l06_boosted_importance")
def q_boosted_importance(spark, sf):
    """L6 on the boosted models: mean gain of a feature's splits, ranked per model."""
    train, _, cols = model_data(spark, sf)
    return glm.ranked_importance(_importance(fitted_boosters(train, cols)))


# ------------------------------------------------------------------ closed forms of the boosters
_STUMP_CUTS = {"BonusMalus": [60.0, 75.0, 90.0, 110.0], "DrivAge": [25.0, 40.0, 60.0], "Exposure": [0.25, 0.5, 0.75]}
_STUMP = bst.BoostParams(rounds=1, max_depth=1, subsample=1.0, colsample_bytree=1.0, learning_rate=0.5)


def _stump_sql() -> str:
    p = _STUMP
    shrunk = lambda g: f"greatest(abs({g}) - {p.reg_alpha}, 0)"
    leaf = lambda g, h: f"greatest(least(-sign({g}) * {shrunk(g)} / ({h} + {p.reg_lambda}), {p.max_delta_step}), -{p.max_delta_step})"
    splits = " UNION ALL ".join(f"SELECT {i} AS f, '{name}' AS feature, CAST({cut} AS DOUBLE) AS cut, CAST({name} AS DOUBLE) >= {cut} AS is_right, g, h FROM gh"
                                for i, (name, cuts) in enumerate(_STUMP_CUTS.items()) for cut in cuts)
    return sql("t AS (SELECT *, CAST(ClaimNb AS DOUBLE) AS y, greatest(Exposure, 0.05) AS e FROM policies)",
               "b AS (SELECT ln(sum(y) / sum(e)) AS base FROM t)",
               f"gh AS (SELECT t.*, exp(ln(e) + base) - y AS g, exp(ln(e) + base + {p.max_delta_step}) AS h FROM t CROSS JOIN b)",
               "tot AS (SELECT sum(g) AS gt, sum(h) AS ht FROM gh)",
               f"s AS (SELECT f, feature, cut, sum(CASE WHEN is_right THEN 0 ELSE g END) AS gl, sum(CASE WHEN is_right THEN 0 ELSE h END) AS hl FROM ({splits}) GROUP BY 1, 2, 3)",
               f"""c AS (SELECT s.*, gt - gl AS gr, ht - hl AS hr, power({shrunk('gl')}, 2) / (hl + {p.reg_lambda}) + power({shrunk('(gt - gl)')}, 2) / (ht - hl + {p.reg_lambda})
                        - power({shrunk('gt')}, 2) / (ht + {p.reg_lambda}) AS gain FROM s CROSS JOIN tot
                   WHERE hl >= {p.min_child_weight} AND ht - hl >= {p.min_child_weight} ORDER BY gain DESC, f, cut LIMIT 1)""",
               f"""SELECT feature, cut, round(gain, 6) AS gain, round({leaf('gl', 'hl')}, 9) AS left_value, round({leaf('gr', 'hr')}, 9) AS right_value,
                          round(base, 9) AS base FROM c CROSS JOIN b""", base="policies")


@query("l02_boosted_stump", _stump_sql())
def q_stump(spark, sf):
    """L2, closed form: one Poisson round of depth 1 over fixed cut points."""
    pol = src.policies(spark, sf).select("IDpol", "ClaimNb", *[c for c in _STUMP_CUTS])
    cuts = bins.Cuts(list(_STUMP_CUTS), [np.array(c) for c in _STUMP_CUTS.values()])
    m = bst.fit_boosted(pol, "stump", list(_STUMP_CUTS), _STUMP, cuts=cuts)
    n = m.nodes()
    at = lambda node, c: F.max(F.when(F.col("node") == node, F.col(c)))
    row = n.agg(at(0, "feature").alias("f"), at(0, "threshold").alias("cut"), F.round(at(0, "gain"), 6).alias("gain"),
                F.round(at(1, "value"), 9).alias("left_value"), F.round(at(2, "value"), 9).alias("right_value"))
    return row.select(F.element_at(F.array(*[F.lit(c) for c in _STUMP_CUTS]), F.col("f") + 1).alias("feature"), "cut", "gain", "left_value", "right_value",
                      F.round(F.lit(m.base), 9).alias("base"))


_FOLD_SQL = f"((('0x' || substr(md5('43:' || CAST(IDpol AS VARCHAR)), 1, 8))::BIGINT % {10000 * FOLDS}) % {FOLDS})"


@query("j05_cv_intercept", sql(f"t AS (SELECT CAST({_FOLD_SQL} AS INT) AS fold, CAST(ClaimNb AS DOUBLE) AS y FROM policies)",
                               "m AS (SELECT f.fold, avg(t.y) AS mu FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY 1)",
                               "r AS (SELECT t.fold, sqrt(avg((y - mu) * (y - mu))) AS rmse FROM t JOIN m ON t.fold = m.fold GROUP BY 1)",
                               """SELECT fold, round(rmse, 9) AS rmse FROM r UNION ALL SELECT -1, round(avg(rmse), 9) FROM r
                                  UNION ALL SELECT -2, round(stddev_pop(rmse), 9) FROM r""", base="policies"))
def q_cv_intercept(spark, sf):
    """J5, closed form: no rounds, so each fold is predicted by the mean of the others."""
    pol = src.policies(spark, sf)
    cv = tune.boosted_cv(pol, ["BonusMalus"], bst.replace(STANDARD, rounds=0, positive_weight=1.0), FOLDS)
    return cv.select("fold", F.round("rmse", 9).alias("rmse"))


@query("j05_boosted_cv_scores")
def q_boosted_cv(spark, sf):
    """J5 on the boosted standard model, whole training split, 5 folds, 100 rounds."""
    train, _, cols = model_data(spark, sf)
    return tune.boosted_cv(train, cols, bst.replace(STANDARD, rounds=CV_ROUNDS, positive_weight=1.0), FOLDS)


@query("j04_boosted_grid")
def q_boosted_grid(spark, sf):
    """All values of six tree parameters x 5 folds, 100 rounds, scored by RMSE and J6 deviance, ranked."""
    train, _, cols = model_data(spark, sf)
    return tune.grid_summary(tune.boosted_grid(train, cols, TUNED, bst.replace(STANDARD, rounds=GRID_ROUNDS, positive_weight=1.0), FOLDS))


@query("j06_deviance_evaluator", O.SCORED + """
SELECT model, round(avg(least(CASE WHEN isnan(d) THEN 0 WHEN isinf(d) THEN 1e10 ELSE d END, 1e6)), 9) AS deviance FROM (
  SELECT model, 2 * (greatest(actual, 1e-10) * ln(greatest(actual, 1e-10) / greatest(predicted, 1e-10)) - (greatest(actual, 1e-10) - greatest(predicted, 1e-10))) AS d
  FROM long_scores) GROUP BY model""")
def q_evaluator(spark, sf):
    """The evaluator on each model's scores."""
    long = src.long_scores(src.scored(spark, sf))
    names = [r[0] for r in long.select("model").distinct().collect()]      # three models
    e = tune.PoissonDevianceEvaluator("actual", "predicted")
    rows = [(m, e.evaluate(long.where(F.col("model") == m))) for m in names]
    return spark.createDataFrame(rows, "model string, deviance double").withColumn("deviance", F.round("deviance", 9))


# ------------------------------------------------------------------ importance by formula, bundle, alignment
_FORMULA = O.FEATURES + ", t AS (" + " UNION ALL ".join(
    f"SELECT VehGas AS model, '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS m, stddev_pop(CAST({c} AS DOUBLE)) AS s FROM features GROUP BY 1"
    for c in ["VehPower", "VehAge", "DrivAge", "BonusMalus", "Density", "LogDensity", "BM_Power", "BM_Age", "CompositeRiskScore", "VehAgePower", "Area", "Region"]) + "), "     "i AS (SELECT CAST(model AS VARCHAR) AS model, feature, round(s / m, 6) AS importance FROM t WHERE m <> 0), "     "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS INT) AS rank FROM i) "


def _formula_importance(spark, sf) -> DataFrame:
    """An importance table that SQL can make too: the coefficient of variation per kind of fuel."""
    fe = feat.engineer(src.policies(spark, sf))[0]
    cols = ["VehPower", "VehAge", "DrivAge", "BonusMalus", "Density", "LogDensity", "BM_Power", "BM_Age", "CompositeRiskScore", "VehAgePower", "Area", "Region"]
    long = fe.select(F.col("VehGas").cast("string").alias("model"), *[F.col(c).cast("double") for c in cols]).unpivot(["model"], cols, "feature", "v")
    t = long.groupBy("model", "feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return t.where("m <> 0").select("model", "feature", F.round(F.col("s") / F.col("m"), 6).alias("importance"))


@query("h01_ranked_importance_formula", _FORMULA + "SELECT model, feature, importance, rank FROM r")
def q_formula_ranked(spark, sf):
    """Stacked and ranked importances."""
    return glm.ranked_importance(_formula_importance(spark, sf))


@query("h03_top10_formula", _FORMULA + "SELECT model, feature, importance, rank FROM r WHERE rank <= 10")
def q_formula_top10(spark, sf):
    return glm.ranked_importance(_formula_importance(spark, sf), 10)


@query("h04_top5_formula", _FORMULA + "SELECT model, feature, importance, rank FROM r WHERE rank <= 5")
def q_formula_top5(spark, sf):
    return glm.ranked_importance(_formula_importance(spark, sf), 5)


@query("a08_bundle_scores", O.POLICIES + """SELECT m.model, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_different
FROM policies, (VALUES ('standard'), ('poisson'), ('tweedie')) m(model)
WHERE ('0x' || substr(md5('42:' || CAST(IDpol AS VARCHAR)), 1, 8))::BIGINT % 10000 < 2000 GROUP BY 1""")
def q_bundle(spark, sf):
    """Models and feature state saved in one session score raw policies in another; compared
    row by row with the scores of the session that fitted them."""
    import uuid
    pol = src.policies(spark, sf)
    fe, state = feat.engineer(pol)
    mf = materialize(glm.model_frame(fe), "model-frame", min_partitions=parallelism(spark))
    train, test = tg.split(mf)
    models = fitted_glms(train, feat.model_columns(mf))
    path = f"{scratch_root(spark)}/bundle-{uuid.uuid4().hex}"
    store.Bundle(pol.schema, state, models).save(path)
    other = spark.newSession()
    raw = materialize(pol.where(tg.split_column() == "test"), "bundle-policies")
    again = materialize(store.load_bundle(other, path).score(raw), "bundle-scores")
    first = _stacked(models, test)
    j = first.join(again.withColumnRenamed("predicted", "later").drop("actual"), ["model", "IDpol"], "full")
    return j.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("predicted").eqNullSafe(F.col("later")), 1)).alias("n_different"))


@query("m01_alignment_injected", sql(
    "a AS (SELECT IDpol FROM policies WHERE IDpol % 89 <> 3 UNION ALL SELECT IDpol FROM policies WHERE IDpol % 500 = 7)",
    "p AS (SELECT IDpol FROM policies WHERE IDpol % 97 <> 5)",
    """x AS (SELECT 'missing_prediction' AS side, IDpol AS k FROM (SELECT DISTINCT IDpol FROM a) WHERE IDpol NOT IN (SELECT IDpol FROM p)
             UNION ALL SELECT 'missing_actual', IDpol FROM p WHERE IDpol NOT IN (SELECT IDpol FROM a)
             UNION ALL SELECT 'repeated_actual', IDpol FROM a GROUP BY IDpol HAVING count(*) > 1)""",
    """SELECT s.side, CAST(count(k) AS BIGINT) AS n, coalesce(array_to_string(list_sort(list(k ORDER BY k) FILTER (k IS NOT NULL))[1:20], ','), '') AS first_keys
       FROM (VALUES ('missing_prediction'), ('missing_actual'), ('repeated_actual'), ('repeated_prediction')) s(side) LEFT JOIN x ON x.side = s.side GROUP BY 1""", base="policies"))
def q_misaligned(spark, sf):
    """M1: what the gate reports on keys left out and repeated by rules on the key."""
    pol = src.policies(spark, sf).select("IDpol")
    a = pol.where("IDpol % 89 <> 3").unionAll(pol.where("IDpol % 500 = 7"))
    m = ev.mismatches(a, pol.where("IDpol % 97 <> 5"))
    return m.select("side", "n", F.array_join(F.transform("first_keys", lambda x: x.cast("string")), ",").alias("first_keys"))


@query("j01_split_sizes", sql("""
SELECT CASE WHEN ('0x' || substr(md5('42:' || CAST(IDpol AS VARCHAR)), 1, 8))::BIGINT % 10000 < 2000
            THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM policies GROUP BY 1""",
                                   base="policies"))
def q_split_sizes(spark, sf):
    """Sizes of the hash split (stable under repartitioning)."""
    pol = src.policies(spark, sf)
    return pol.groupBy(tg.split_column().alias("split")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("j02_fold_sizes", sql("""
SELECT CAST(((('0x' || substr(md5('43:' || CAST(IDpol AS VARCHAR)), 1, 8))::BIGINT % 50000) % 5) AS INT) AS fold,
       CAST(count(*) AS BIGINT) AS n FROM policies GROUP BY 1""", base="policies"))
def q_fold_sizes(spark, sf):
    pol = src.policies(spark, sf)
    return pol.groupBy(tg.fold_column().alias("fold")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("j05_cv_scores")
def q_cv(spark, sf):
    """J5 on the whole training split, 5 folds."""
    train, _, cols = model_data(spark, sf)
    return tune.cv_scores(train, cols)


@query("j04_grid_search_deviance")
def q_grid(spark, sf):
    """Small grid x 3-fold CV scored by Poisson deviance."""
    train, _, cols = model_data(spark, sf)
    return tune.grid_search(train, cols)
