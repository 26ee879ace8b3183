"""Registered queries for ranking (G), evaluation (M, H, I, E), EDA tables
(F14-F22) and target preparation (K). Spark side uses the operators; the
oracle side is plain DuckDB SQL over the same parquet tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda
from ..operators import evaluate as ev
from ..operators import features as feat
from ..operators import ranking as rk
from ..operators import target as tg
from ..operators.ordering import global_row_number
from ..sources import tables as src
from . import oracle_sql as O
from .catalog import FEATURE_COLUMNS, TRANSCENDENTAL, _feature_dump, features, policies, query, r6

MODELS = src.MODELS


def r9(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 9)


def long_scores(spark, sf):
    return src.long_scores(src.scored(spark, sf))


def sql(*ctes: str, base: str = "scored") -> str:
    parts = {"policies": [src.POLICIES_SQL], "scored": [src.POLICIES_SQL, src.SCORED_SQL],
             "features": [src.POLICIES_SQL, O.FEATURES_SQL],
             "features_scored": [src.POLICIES_SQL, O.FEATURES_SQL, src.SCORED_SQL]}[base]
    return O.with_ctes(*parts, *ctes[:-1]) + ctes[-1]


# ------------------------------------------------------------------ C3 / F20 / F21
@query("c03_finite_pairs", sql("""
SELECT model, CAST(count(*) AS BIGINT) AS n_valid, CAST(0 AS BIGINT) AS n_removed
FROM long_scores WHERE isfinite(predicted) GROUP BY model"""))
def q_finite_pairs(spark, sf):
    return rk.finite_pair_counts(long_scores(spark, sf))


@query("f20_prediction_ranges", sql("""
SELECT model, CAST(min(actual) AS DOUBLE) AS min_actual, CAST(max(actual) AS DOUBLE) AS max_actual,
       min(predicted) AS min_predicted, max(predicted) AS max_predicted FROM long_scores GROUP BY model"""))
def q_ranges(spark, sf):
    return eda.ranges(long_scores(spark, sf))


@query("f21_positive_rate", sql("""
SELECT model, round(avg(CASE WHEN actual > 0 THEN 1e0 ELSE 0e0 END), 9) AS positive_rate,
       CAST(count(DISTINCT actual > 0) AS BIGINT) AS n_classes FROM long_scores GROUP BY model"""))
def q_positive_rate(spark, sf):
    return eda.positive_rate(long_scores(spark, sf)).withColumn("positive_rate", r9("positive_rate"))


# ------------------------------------------------------------------ G: ranking
_RANK_CTE = """r AS (SELECT model, IDpol, actual, predicted,
       row_number() OVER (PARTITION BY model ORDER BY predicted, IDpol) AS rk,
       count(*) OVER (PARTITION BY model) AS n FROM long_scores)"""


@query("g01_first_rank", sql(_RANK_CTE, "SELECT model, IDpol, CAST(rk AS BIGINT) AS rank FROM r"))
def q_first_rank(spark, sf):
    return rk.ranked(long_scores(spark, sf)).select("model", "IDpol", F.col("rank").cast("bigint").alias("rank"))


@query("g02_quantile_bins", sql(_RANK_CTE, """
SELECT model, IDpol, CAST(CASE WHEN n <= 1 THEN 0 ELSE greatest(0, ceil((rk - 1) * 10e0 / (n - 1)) - 1) END AS INT) AS bin
FROM r"""))
def q_quantile_bins(spark, sf):
    from ..functions.exprs import qcut_bin
    r = rk.ranked(long_scores(spark, sf))
    return r.select("model", "IDpol", qcut_bin(F.col("rank"), F.col("n"), 10).alias("bin"))


def _lift_sql(bin_expr: str) -> str:
    return sql(_RANK_CTE, f"b AS (SELECT *, CAST({bin_expr} AS INT) AS bin FROM r)",
               "o AS (SELECT model, avg(actual) AS overall FROM long_scores GROUP BY model)", """
SELECT b.model, bin, round(avg(actual), 6) AS avg_actual, round(avg(predicted), 6) AS avg_predicted,
       CAST(count(*) AS BIGINT) AS count,
       round(avg(actual) / CASE WHEN max(o.overall) = 0 THEN 1e-10 ELSE max(o.overall) END, 6) AS lift
FROM b JOIN o ON b.model = o.model GROUP BY b.model, bin""")


def _lift(spark, sf, method):
    t = rk.lift_table(long_scores(spark, sf), 10, method=method)
    return t.select("model", "bin", r6("avg_actual").alias("avg_actual"), r6("avg_predicted").alias("avg_predicted"),
                    "count", r6("lift").alias("lift"))


@query("g04_lift_table", _lift_sql("CASE WHEN n <= 1 THEN 0 ELSE greatest(0, ceil((rk - 1) * 10e0 / (n - 1)) - 1) END"))
def q_lift(spark, sf):
    return _lift(spark, sf, "qcut")


@query("g03_lift_table_positional", _lift_sql("least(floor((rk - 1) * 10e0 / n), 9)"))
def q_lift_positional(spark, sf):
    return _lift(spark, sf, "position")


_PR_CTES = (
    """d AS (SELECT model, predicted AS threshold, sum(CASE WHEN actual > 0 THEN 1 ELSE 0 END) AS p, count(*) AS k
             FROM long_scores GROUP BY model, predicted)""",
    """c AS (SELECT model, threshold, p,
             sum(p) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(k) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS kk,
             sum(p) OVER (PARTITION BY model) AS tot FROM d)""",
    """e AS (SELECT model, threshold, tp * 1e0 / kk AS prec, tp * 1e0 / tot AS rec, p * 1e0 / tot AS dr FROM c)""",
    """f AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0e0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM e)""",
)


@query("g05_pr_curve", sql(*_PR_CTES, """
SELECT model, threshold, round(prec, 9) AS precision, round(rec, 9) AS recall, round(f1, 9) AS f1 FROM f
UNION ALL SELECT model, CAST(NULL AS DOUBLE), 1e0, 0e0, 0e0 FROM (SELECT DISTINCT model FROM long_scores) m"""))
def q_pr_curve(spark, sf):
    c = rk.pr_curve(long_scores(spark, sf))
    return c.select("model", "threshold", r9("precision").alias("precision"), r9("recall").alias("recall"),
                    r9("f1").alias("f1"))


@query("g06_average_precision_best_f1", sql(*_PR_CTES, """
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS rn
         FROM f) t WHERE rn = 1)""", """
SELECT f.model, round(sum(f.dr * f.prec), 9) AS average_precision, max(b.threshold) AS best_threshold,
       round(max(b.prec), 9) AS best_precision, round(max(b.rec), 9) AS best_recall, round(max(b.f1), 9) AS best_f1,
       CAST(count(*) AS BIGINT) AS n_points
FROM f JOIN best b ON f.model = b.model GROUP BY f.model"""))
def q_average_precision(spark, sf):
    s = rk.pr_summary(long_scores(spark, sf))
    return s.select("model", r9("average_precision").alias("average_precision"), "best_threshold",
                    r9("best_precision").alias("best_precision"), r9("best_recall").alias("best_recall"),
                    r9("best_f1").alias("best_f1"), "n_points")


# ------------------------------------------------------------------ M: metrics
_SCALAR_CTES = (
    """st AS (SELECT model, count(*) AS n, avg(CASE WHEN actual > 0 THEN 1e0 ELSE 0e0 END) AS claim_rate
              FROM long_scores GROUP BY model)""",
    """cp AS (SELECT model, quantile_cont(actual, 0.999) * 1.5 AS cap FROM long_scores WHERE actual > 0 GROUP BY model)""",
    """rk AS (SELECT model, predicted, row_number() OVER (PARTITION BY model ORDER BY predicted) - 1 AS k
              FROM long_scores)""",
    """ps AS (SELECT model, claim_rate, (n - 1) * (1 - claim_rate) AS pos FROM st)""",
    """thr AS (SELECT ps.model, CASE WHEN ps.claim_rate > 0 THEN
                 CASE WHEN lo.predicted = hi.predicted THEN lo.predicted
                      ELSE lo.predicted + (ps.pos - floor(ps.pos)) * (hi.predicted - lo.predicted) END
               ELSE 5e-1 END AS threshold
               FROM ps JOIN rk lo ON lo.model = ps.model AND lo.k = floor(ps.pos)
                       JOIN rk hi ON hi.model = ps.model AND hi.k = ceil(ps.pos))""",
    """sc AS (SELECT st.model, coalesce(cp.cap, 10e0) AS cap, thr.threshold FROM st
              LEFT JOIN cp ON st.model = cp.model LEFT JOIN thr ON st.model = thr.model)""",
    """j AS (SELECT l.model, CAST(l.actual AS DOUBLE) AS y, l.predicted AS p, least(l.predicted, sc.cap) AS pc,
                    sc.threshold, sc.cap FROM long_scores l JOIN sc ON l.model = sc.model)""",
)

_DEV_MODULE = ("least(greatest(2 * ((CASE WHEN greatest(y, 1e-10) > 1e-10 THEN greatest(y, 1e-10) * "
               "ln(greatest(y, 1e-10) / greatest(p, 1e-10)) ELSE 0e0 END) - (greatest(y, 1e-10) - greatest(p, 1e-10))), "
               "-1e6), 1e6)")


def _cls_sql(cond, name):
    return (f"round(sqrt(sum(CASE WHEN {cond} THEN (y - p) * (y - p) END) / count(CASE WHEN {cond} THEN 1 END)), 9) "
            f"AS {name}_rmse, round(sum(CASE WHEN {cond} THEN abs(y - p) END) / count(CASE WHEN {cond} THEN 1 END), 9) "
            f"AS {name}_mae")


_TP, _FP, _FN = ("count(CASE WHEN y > 0 AND p > threshold THEN 1 END)",
                 "count(CASE WHEN y <= 0 AND p > threshold THEN 1 END)",
                 "count(CASE WHEN y > 0 AND p <= threshold THEN 1 END)")

_METRIC_SQL = sql(*_SCALAR_CTES, f"""
SELECT model, round(sqrt(avg((y - pc) * (y - pc))), 9) AS rmse, round(avg(abs(y - pc)), 9) AS mae,
       round(CASE WHEN var_pop(y) * count(*) > 1e-10 THEN 1 - sum((y - pc) * (y - pc)) / (var_pop(y) * count(*))
             ELSE 0e0 END, 9) AS r2,
       round(avg({_DEV_MODULE}), 9) AS poisson_deviance,
       {_cls_sql("y = 0", "low")}, {_cls_sql("y = 1", "medium")}, {_cls_sql("y > 1", "high")},
       round((count(*) - {_FP} - {_FN}) * 1e0 / count(*), 9) AS accuracy,
       round(CASE WHEN {_TP} + {_FP} = 0 THEN 0e0 ELSE {_TP} * 1e0 / ({_TP} + {_FP}) END, 9) AS precision,
       round(CASE WHEN {_TP} + {_FN} = 0 THEN 0e0 ELSE {_TP} * 1e0 / ({_TP} + {_FN}) END, 9) AS recall,
       round(CASE WHEN 2 * {_TP} + {_FP} + {_FN} = 0 THEN 0e0 ELSE 2e0 * {_TP} / (2 * {_TP} + {_FP} + {_FN}) END, 9) AS f1,
       round(max(threshold), 9) AS threshold
FROM j GROUP BY model""")


def _metric_rows(spark, sf):
    m = ev.metric_rows(long_scores(spark, sf))
    return m.select("model", *[r9(c).alias(c) for c in ev.METRIC_COLUMNS])


@query("m12_metric_rows", _METRIC_SQL)
def q_metric_rows(spark, sf):
    return _metric_rows(spark, sf)


@query("m02_caps_thresholds", sql(*_SCALAR_CTES, """
SELECT st.model, CAST(st.n AS BIGINT) AS n, round(st.claim_rate, 9) AS claim_rate, round(sc.cap, 9) AS cap,
       round(sc.threshold, 9) AS threshold FROM st JOIN sc ON st.model = sc.model"""))
def q_caps(spark, sf):
    s = ev.scalars(long_scores(spark, sf))
    return s.select("model", F.col("n").cast("bigint").alias("n"), r9("claim_rate").alias("claim_rate"),
                    r9("cap").alias("cap"), r9("threshold").alias("threshold"))


@query("m07_class_metrics", sql("""
cls AS (SELECT model, risk_class FROM (SELECT DISTINCT model FROM long_scores) m,
        (VALUES ('low'), ('medium'), ('high')) v(risk_class))""",
                                """
s AS (SELECT model, CASE WHEN actual = 0 THEN 'low' WHEN actual = 1 THEN 'medium' WHEN actual > 1 THEN 'high' END
             AS risk_class, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
             avg(abs(actual - predicted)) AS mae, count(*) AS n FROM long_scores GROUP BY 1, 2)""", """
SELECT cls.model, cls.risk_class, round(s.rmse, 9) AS rmse, round(s.mae, 9) AS mae, CAST(s.n AS BIGINT) AS n
FROM cls LEFT JOIN s ON cls.model = s.model AND cls.risk_class = s.risk_class"""))
def q_class_metrics(spark, sf):
    c = ev.class_metrics(long_scores(spark, sf))
    return c.select("model", "risk_class", r9("rmse").alias("rmse"), r9("mae").alias("mae"), "n")


_DEV_NB = ("least(2 * (greatest(y, 1e-10) * ln(greatest(y, 1e-10) / greatest(pc, 1e-10)) "
           "- (greatest(y, 1e-10) - greatest(pc, 1e-10))), 1e6)")


@query("m06_notebook_metrics", sql(*_SCALAR_CTES, f"""
SELECT model, round(avg({_DEV_NB}), 9) AS poisson_deviance_nb,
       round(sqrt(sum(CASE WHEN y = 0 THEN (y - p) * (y - p) END) / count(CASE WHEN y = 0 THEN 1 END)), 9) AS zero_rmse,
       round(sum(CASE WHEN y = 0 THEN abs(y - p) END) / count(CASE WHEN y = 0 THEN 1 END), 9) AS zero_mae,
       round(sqrt(sum(CASE WHEN y > 0 THEN (y - p) * (y - p) END) / count(CASE WHEN y > 0 THEN 1 END)), 9) AS nonzero_rmse,
       round(sum(CASE WHEN y > 0 THEN abs(y - p) END) / count(CASE WHEN y > 0 THEN 1 END), 9) AS nonzero_mae
FROM j GROUP BY model"""))
def q_notebook_metrics(spark, sf):
    m = ev.notebook_metrics(long_scores(spark, sf))
    return m.select("model", *[r9(c).alias(c) for c in m.columns if c != "model"])


@query("m08_notebook_risk_groups", sql("""
md AS (SELECT model, quantile_cont(actual, 0.5) AS med, count(*) AS npos FROM long_scores WHERE actual > 0 GROUP BY model)""",
                                       """
SELECT l.model, CASE WHEN actual = 0 THEN 'Low Risk' WHEN md.npos > 10 THEN
                    CASE WHEN actual > md.med THEN 'High Risk' ELSE 'Medium Risk' END ELSE 'High Risk' END AS risk_group,
       round(sqrt(avg((actual - predicted) * (actual - predicted))), 9) AS rmse,
       round(avg(abs(actual - predicted)), 9) AS mae, CAST(count(*) AS BIGINT) AS n
FROM long_scores l LEFT JOIN md ON l.model = md.model GROUP BY 1, 2"""))
def q_nb_risk_groups(spark, sf):
    m = ev.notebook_risk_groups(long_scores(spark, sf))
    return m.select("model", "risk_group", r9("rmse").alias("rmse"), r9("mae").alias("mae"), "n")


@query("m05_poisson_deviance", sql("""
SELECT model, round(avg(least(greatest(2 * ((CASE WHEN greatest(actual, 1e-10) > 1e-10 THEN greatest(actual, 1e-10) *
       ln(greatest(actual, 1e-10) / greatest(predicted, 1e-10)) ELSE 0e0 END) - (greatest(actual, 1e-10)
       - greatest(predicted, 1e-10))), -1e6), 1e6)), 9) AS poisson_deviance FROM long_scores GROUP BY model"""))
def q_deviance(spark, sf):
    from ..functions.exprs import poisson_deviance_term
    return long_scores(spark, sf).groupBy("model").agg(
        r9(F.avg(poisson_deviance_term(F.col("actual"), F.col("predicted"), "module"))).alias("poisson_deviance"))


@query("m13_key_metric_comparison", sql(*_SCALAR_CTES, f"""
m AS (SELECT model, sqrt(avg((y - pc) * (y - pc))) AS rmse, avg(abs(y - pc)) AS mae,
      CASE WHEN var_pop(y) * count(*) > 1e-10 THEN 1 - sum((y - pc) * (y - pc)) / (var_pop(y) * count(*)) ELSE 0e0 END AS r2,
      avg({_DEV_MODULE}) AS poisson_deviance,
      CASE WHEN 2 * {_TP} + {_FP} + {_FN} = 0 THEN 0e0 ELSE 2e0 * {_TP} / (2 * {_TP} + {_FP} + {_FN}) END AS f1
      FROM j GROUP BY model)""", """
u AS (SELECT model, 'rmse' AS metric, rmse AS value FROM m UNION ALL SELECT model, 'mae', mae FROM m
      UNION ALL SELECT model, 'r2', r2 FROM m UNION ALL SELECT model, 'poisson_deviance', poisson_deviance FROM m
      UNION ALL SELECT model, 'f1', f1 FROM m)""", """
SELECT metric, round(max(CASE WHEN model = 'standard' THEN value END), 9) AS standard,
       round(max(CASE WHEN model = 'poisson' THEN value END), 9) AS poisson,
       round(max(CASE WHEN model = 'tweedie' THEN value END), 9) AS tweedie FROM u GROUP BY metric"""))
def q_key_comparison(spark, sf):
    m = ev.metric_rows(long_scores(spark, sf))
    c = ev.key_comparison(m, MODELS)
    return c.select("metric", *[r9(x).alias(x) for x in MODELS])


_BEST_SQL_CTES = (*_SCALAR_CTES, f"""
m AS (SELECT model, CASE WHEN 2 * {_TP} + {_FP} + {_FN} = 0 THEN 0e0 ELSE 2e0 * {_TP} / (2 * {_TP} + {_FP} + {_FN}) END AS f1
      FROM j GROUP BY model)""", """
best AS (SELECT model, f1 FROM m ORDER BY f1 DESC, CASE model WHEN 'standard' THEN 0 WHEN 'poisson' THEN 1
         WHEN 'tweedie' THEN 2 ELSE 99 END, model LIMIT 1)""")


@query("m14_best_model", sql(*_BEST_SQL_CTES, "SELECT model, round(f1, 9) AS f1 FROM best"))
def q_best_model(spark, sf):
    b = ev.best_model(ev.metric_rows(long_scores(spark, sf)))
    return b.select("model", r9("f1").alias("f1"))


# ------------------------------------------------------------------ E / H: errors
# The policy columns beside each error, as the reference study shows them.
CONTEXT = ["Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density"]


@query("e01_error_frame", sql(f"""
SELECT s.IDpol, s.actual, s.predicted_standard, s.predicted_poisson, s.predicted_tweedie,
       s.predicted_standard - s.actual AS error_standard, abs(s.predicted_standard - s.actual) AS abs_error_standard,
       s.predicted_poisson - s.actual AS error_poisson, abs(s.predicted_poisson - s.actual) AS abs_error_poisson,
       s.predicted_tweedie - s.actual AS error_tweedie, abs(s.predicted_tweedie - s.actual) AS abs_error_tweedie,
       {", ".join("f." + c for c in CONTEXT)}
FROM scored s LEFT JOIN features f ON s.IDpol = f.IDpol""", base="features_scored"))
def q_error_frame(spark, sf):
    pol = policies(spark, sf)
    fe = feat.engineer(pol)[0]
    return ev.error_frame(src.scored_from(pol), fe, MODELS, context_cols=CONTEXT)


@query("h02_top_errors", sql("""
e AS (SELECT model, IDpol, actual, predicted, predicted - actual AS error, abs(predicted - actual) AS abs_error,
             row_number() OVER (PARTITION BY model ORDER BY abs(predicted - actual) DESC, IDpol) AS rn FROM long_scores)""",
                             f"""SELECT e.model, e.IDpol, e.actual, e.predicted, e.error, e.abs_error,
       {", ".join("f." + c for c in CONTEXT)} FROM e JOIN features f ON e.IDpol = f.IDpol WHERE rn <= 10""",
                             base="features_scored"))
def q_top_errors(spark, sf):
    """H2: ten largest absolute errors per model with policy context."""
    pol = policies(spark, sf)
    top = ev.top_errors(src.long_scores(src.scored_from(pol)), 10, models=MODELS)
    fe = feat.engineer(pol)[0]
    # broadcast bound: ten rows per model
    return fe.select("IDpol", *CONTEXT).join(F.broadcast(top), "IDpol").select(
        "model", "IDpol", "actual", "predicted", "error", "abs_error", *CONTEXT)


_ALL_FEATURES = ", ".join(f"round(f.{c}, 6) AS {c}" if c in TRANSCENDENTAL else f"f.{c}" for c in FEATURE_COLUMNS if c != "IDpol")


@query("h06_best_model_top_errors", sql(*_BEST_SQL_CTES, f"""
e AS (SELECT l.model, l.IDpol, l.actual, l.predicted, abs(l.actual - l.predicted) AS error
      FROM long_scores l JOIN best b ON l.model = b.model ORDER BY error DESC, l.IDpol LIMIT 10)""", f"""
SELECT e.*, {_ALL_FEATURES} FROM e JOIN features f ON e.IDpol = f.IDpol""",
                                        base="features_scored"))
def q_best_top_errors(spark, sf):
    """H6: the best model's ten largest errors with every feature of the policies."""
    pol = policies(spark, sf)
    long = src.long_scores(src.scored_from(pol))
    best = ev.best_model(ev.metric_rows(long)).first()["model"]       # one row
    fe = feat.engineer(pol)[0]
    return ev.best_model_errors(long, best, _feature_dump(fe, FEATURE_COLUMNS), 10)


FIRST_N = 10_000   # rows of the H5 subset, as the reference study takes


@query("h05_first_n_subset", sql("SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in ("LogDensity", "LogExposure", "BM_Exp") else c for c in [
        "IDpol", "ClaimNb", "Exposure", "Area", "VehPower", "VehAge", "DrivAge", "BonusMalus", "VehBrand", "VehGas",
        "Density", "Region", "VeryShortExposure", "LogDensity", "DensityGroup", "LogExposure", "BM_Exp",
        "CompositeRiskScore", "RiskSegment"]) + " FROM features ORDER BY IDpol LIMIT {FIRST_N}".replace("{FIRST_N}", str(FIRST_N)), base="features"))
def q_first_n(spark, sf, n: int = FIRST_N):
    """H5: the first n rows by key, by a distributed rank."""
    cols = ["IDpol", "ClaimNb", "Exposure", "Area", "VehPower", "VehAge", "DrivAge", "BonusMalus", "VehBrand",
            "VehGas", "Density", "Region", "VeryShortExposure", "LogDensity", "DensityGroup", "LogExposure", "BM_Exp",
            "CompositeRiskScore", "RiskSegment"]
    ranked = global_row_number(_feature_dump(features(spark, sf), cols), ["IDpol"])
    return ranked.filter(F.col("rn") <= n).select(*cols)


# ------------------------------------------------------------------ F14-F19, F22: EDA tables
def _hist_sql(union: str, bins: int) -> tuple:
    """CTEs + select of an equal-width histogram over ``lg(variable, value)``."""
    return (f"lg AS ({union})",
            "rg AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM lg WHERE value IS NOT NULL GROUP BY variable)",
            f"""cnt AS (SELECT lg.variable, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) * {float(bins)} / (hi - lo)),
                    {bins - 1}) END AS INT) AS bin, count(*) AS c FROM lg JOIN rg ON lg.variable = rg.variable
                    WHERE value IS NOT NULL GROUP BY 1, 2)""",
            f"""SELECT rg.variable, CAST(b.bin AS INT) AS bin, round(lo + (hi - lo) * b.bin / {float(bins)}, 9) AS lo,
                round(lo + (hi - lo) * (b.bin + 1) / {float(bins)}, 9) AS hi, CAST(coalesce(cnt.c, 0) AS BIGINT) AS count
                FROM rg CROSS JOIN range({bins}) b(bin) LEFT JOIN cnt ON cnt.variable = rg.variable AND cnt.bin = b.bin""")


def _union(source: str, exprs: dict[str, str], where: dict[str, str] | None = None) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS variable, CAST({v} AS DOUBLE) AS value FROM {source}"
                              + (f" WHERE {where[k]}" if where else "") for k, v in exprs.items())


def _hist_out(h):
    return h.select("variable", "bin", r9("lo").alias("lo"), r9("hi").alias("hi"), "count")


@query("f14_histograms", sql(*_hist_sql(_union("policies", {c: c for c in src.CONTINUOUS}), 30), base="policies"))
def q_histograms(spark, sf):
    return _hist_out(eda.histogram(eda.to_long(policies(spark, sf), src.CONTINUOUS), 30))


@query("f19_error_histograms", sql(*_hist_sql(_union(
    "long_scores", {m: "actual - predicted" for m in MODELS},
    {m: f"model = '{m}' AND abs(actual - predicted) < 2" for m in MODELS}), 50)))
def q_error_histograms(spark, sf):
    long = long_scores(spark, sf)
    err = long.select(F.col("model").alias("variable"), (F.col("actual") - F.col("predicted")).alias("value")) \
              .where(F.abs(F.col("value")) < 2)
    return _hist_out(eda.histogram(err, 50))


@query("f19_error_comparison_histograms", sql(*_hist_sql(_union(
    "long_scores", {m: "predicted - actual" for m in MODELS}, {m: f"model = '{m}'" for m in MODELS}), 50)))
def q_error_comparison(spark, sf):
    long = long_scores(spark, sf)
    err = long.select(F.col("model").alias("variable"), (F.col("predicted") - F.col("actual")).alias("value"))
    return _hist_out(eda.histogram(err, 50))


def _box_sql(source: str, value_sql: dict[str, str], group: str | None, where: str = "TRUE") -> tuple:
    gsel = f", {group} AS grp" if group else ", 0 AS grp"
    union = " UNION ALL ".join(f"SELECT '{k}' AS variable, CAST({v} AS DOUBLE) AS value{gsel} FROM {source} "
                               f"WHERE {where}" for k, v in value_sql.items())
    return (f"lg AS ({union})",
            """q AS (SELECT variable, grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
                    quantile_cont(value, 0.75) AS q3 FROM lg WHERE value IS NOT NULL GROUP BY 1, 2)""",
            """SELECT q.variable, q.grp, CAST(count(*) AS BIGINT) AS n, round(q1, 9) AS q1, round(med, 9) AS median,
                      round(q3, 9) AS q3, round(q3 - q1, 9) AS iqr,
                      min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_low,
                      max(CASE WHEN value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
                      CAST(count(CASE WHEN NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) THEN 1 END) AS BIGINT)
                        AS n_outliers
               FROM lg JOIN q ON lg.variable = q.variable AND lg.grp = q.grp WHERE value IS NOT NULL
               GROUP BY q.variable, q.grp, q1, med, q3""")


def _box_out(b, grp):
    return b.select("variable", F.col(grp).alias("grp"), "n", r9("q1").alias("q1"), r9("median").alias("median"),
                    r9("q3").alias("q3"), r9("iqr").alias("iqr"), "whisker_low", "whisker_high", "n_outliers")


@query("f16_box_stats_by_claims", sql(*_box_sql("policies", {c: c for c in src.CONTINUOUS}, "ClaimNb", "ClaimNb < 5"),
                                      base="policies"))
def q_box_by_claims(spark, sf):
    long = eda.to_long(policies(spark, sf).where("ClaimNb < 5"), src.CONTINUOUS, ids=["ClaimNb"])
    return _box_out(eda.box_stats(long, ["variable", "ClaimNb"]), "ClaimNb")


@query("f17_risk_level_box", sql(*_box_sql("features", {"CompositeRiskScore": "CompositeRiskScore"}, None),
                                 base="features"))
def q_risk_box(spark, sf):
    f = features(spark, sf)
    risk_vars = [c for c in f.columns if c.endswith("_Risk") or c == "CompositeRiskScore"]
    long = eda.to_long(f, risk_vars, name="variable", value="value").withColumn("grp", F.lit(0))
    return _box_out(eda.box_stats(long, ["variable", "grp"]), "grp")


@query("f15_kde", sql(
    f"lg AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS variable, CAST({c} AS DOUBLE) AS value FROM policies' for c in src.CONTINUOUS)})",
    """st AS (SELECT variable, min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS sd,
              stddev_samp(value) * pow(CAST(count(value) AS DOUBLE), -0.2) AS h FROM lg GROUP BY variable)""",
    """bn AS (SELECT lg.variable, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) * 512e0 / (hi - lo)), 511) END AS INT)
              AS b, count(*) AS c FROM lg JOIN st ON lg.variable = st.variable WHERE value IS NOT NULL GROUP BY 1, 2)""",
    """pt AS (SELECT bn.variable, bn.c, st.lo + (bn.b + 0.5) * (st.hi - st.lo) / 512e0 AS x, st.lo, st.hi, st.n, st.h
              FROM bn JOIN st ON bn.variable = st.variable)""",
    """SELECT variable, CAST(g.i AS INT) AS grid_index, round(lo + (hi - lo) * g.i / 199e0, 6) AS x,
              round(sum(c * exp(-0.5 * ((lo + (hi - lo) * g.i / 199e0 - x) / h) * ((lo + (hi - lo) * g.i / 199e0 - x) / h)))
                    / (max(n) * max(h) * sqrt(2 * pi())), 9) AS density
       FROM pt CROSS JOIN range(200) g(i) GROUP BY variable, g.i, lo, hi""", base="policies"))
def q_kde(spark, sf):
    k = eda.kde(eda.to_long(policies(spark, sf), src.CONTINUOUS))
    return k.select("variable", F.col("grid_index").cast("int").alias("grid_index"), r6("x").alias("x"),
                    r9("density").alias("density"))


@query("f15_error_kde", sql(
    "lg AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS variable, CAST(actual - predicted AS DOUBLE) AS value FROM long_scores "
        f"WHERE model = '{m}' AND abs(actual - predicted) < 2" for m in MODELS) + ")",
    """st AS (SELECT variable, min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS sd,
              stddev_samp(value) * pow(CAST(count(value) AS DOUBLE), -0.2) AS h FROM lg GROUP BY variable)""",
    """bn AS (SELECT lg.variable, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) * 512e0 / (hi - lo)), 511) END AS INT)
              AS b, count(*) AS c FROM lg JOIN st ON lg.variable = st.variable WHERE value IS NOT NULL GROUP BY 1, 2)""",
    """pt AS (SELECT bn.variable, bn.c, st.lo + (bn.b + 0.5) * (st.hi - st.lo) / 512e0 AS x, st.lo, st.hi, st.n, st.h
              FROM bn JOIN st ON bn.variable = st.variable)""",
    """SELECT variable, CAST(g.i AS INT) AS grid_index, round(lo + (hi - lo) * g.i / 199e0, 6) AS x,
              round(sum(c * exp(-0.5 * ((lo + (hi - lo) * g.i / 199e0 - x) / h) * ((lo + (hi - lo) * g.i / 199e0 - x) / h)))
                    / (max(n) * max(h) * sqrt(2 * pi())), 9) AS density
       FROM pt CROSS JOIN range(200) g(i) GROUP BY variable, g.i, lo, hi"""))
def q_error_kde(spark, sf):
    """F15 for the error plot: KDE of actual - predicted within |error| < 2, per model."""
    long = long_scores(spark, sf)
    err = long.select(F.col("model").alias("variable"), (F.col("actual") - F.col("predicted")).alias("value")) \
              .where(F.abs(F.col("value")) < 2)
    k = eda.kde(err)
    return k.select("variable", F.col("grid_index").cast("int").alias("grid_index"), r6("x").alias("x"),
                    r9("density").alias("density"))


@query("f22_actual_vs_predicted_density", sql("""
rg AS (SELECT model, min(predicted) AS lo, max(predicted) AS hi FROM long_scores GROUP BY model)""", """
SELECT l.model, l.actual, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((predicted - lo) * 50e0 / (hi - lo)), 49) END AS INT)
       AS predicted_bin, CAST(count(*) AS BIGINT) AS count
FROM long_scores l JOIN rg ON l.model = rg.model GROUP BY 1, 2, 3"""))
def q_scatter(spark, sf):
    return eda.scatter_density(long_scores(spark, sf))


# ------------------------------------------------------------------ K: target preparation
@query("k01_target_preparation", sql("""
t AS (SELECT IDpol, ClaimNb, greatest(Exposure, 5e-2) AS exposure_adj FROM policies)""", """
cap AS (SELECT quantile_cont(ClaimNb / exposure_adj, 0.99) AS cap FROM t WHERE ClaimNb / exposure_adj > 0)""", """
SELECT IDpol, round(exposure_adj, 9) AS exposure_adj, round(ln(exposure_adj), 9) AS offset,
       round(ClaimNb / exposure_adj, 9) AS frequency,
       round(greatest(least(ClaimNb / exposure_adj, cap.cap), 1e-6), 9) AS target
FROM t CROSS JOIN cap""", base="policies"))
def q_target(spark, sf):
    pol = policies(spark, sf)
    prep = tg.TargetPrep.fit(pol, mode="reference")
    t = prep.transform(pol)
    return t.select("IDpol", r9("exposure_adj").alias("exposure_adj"), r9("offset").alias("offset"),
                    r9("frequency").alias("frequency"), r9("target").alias("target"))


@query("k04_frequency_cap", sql("""
t AS (SELECT ClaimNb / greatest(Exposure, 5e-2) AS f FROM policies)""", """
SELECT round(quantile_cont(f, 0.99), 9) AS cap, CAST(count(*) AS BIGINT) AS n_positive FROM t WHERE f > 0""",
                                      base="policies"))
def q_freq_cap(spark, sf):
    pol = policies(spark, sf)
    prep = tg.TargetPrep.fit(pol, mode="reference")
    n = pol.where(F.col("ClaimNb") > 0).agg(F.count(F.lit(1)).cast("bigint").alias("n_positive"))
    return n.select(F.round(F.lit(prep.cap).cast("double"), 9).alias("cap"), "n_positive")


# ------------------------------------------------------------------ I2 / A7: stacked metrics, summary
_KEY_M_CTE = f"""
m AS (SELECT model, sqrt(avg((y - pc) * (y - pc))) AS rmse, avg(abs(y - pc)) AS mae,
      CASE WHEN var_pop(y) * count(*) > 1e-10 THEN 1 - sum((y - pc) * (y - pc)) / (var_pop(y) * count(*)) ELSE 0e0 END AS r2,
      avg({_DEV_MODULE}) AS poisson_deviance,
      CASE WHEN 2 * {_TP} + {_FP} + {_FN} = 0 THEN 0e0 ELSE 2e0 * {_TP} / (2 * {_TP} + {_FP} + {_FN}) END AS f1
      FROM j GROUP BY model)"""


@query("i02_key_metrics_by_model", sql(*_SCALAR_CTES, _KEY_M_CTE, """
SELECT model, round(rmse, 9) AS rmse, round(mae, 9) AS mae, round(r2, 9) AS r2,
       round(poisson_deviance, 9) AS poisson_deviance, round(f1, 9) AS f1 FROM m"""))
def q_key_metrics(spark, sf):
    m = ev.metric_rows(long_scores(spark, sf))
    return m.select("model", *[r9(c).alias(c) for c in ev.KEY_METRICS])


_A7_COLUMNS = ["VehPower", "VehAge", "DrivAge", "BonusMalus", "Density", "LogDensity", "BM_Power", "BM_Age", "CompositeRiskScore", "VehAgePower", "Area", "Region"]


@query("a07_comparison_summary", sql(*_SCALAR_CTES, _KEY_M_CTE,
       "v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS i, avg(CAST({c} AS DOUBLE)) AS a, stddev_pop(CAST({c} AS DOUBLE)) AS s FROM features" for i, c in enumerate(_A7_COLUMNS)) + ")",
       "w AS (SELECT x.model, feature, round(s / a / (1 + (i + x.shift) % 5), 6) AS importance FROM v, (VALUES ('standard', 0), ('poisson', 1), ('tweedie', 2)) x(model, shift))",
       "t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rn FROM w)", """
SELECT 'metrics' AS section, model, name, round(value, 9) AS value FROM m
UNPIVOT (value FOR name IN (rmse, mae, r2, poisson_deviance, f1))
UNION ALL SELECT 'top_features', model, feature, importance FROM t WHERE rn <= 10""", base="features_scored"))
def q_summary(spark, sf):
    """Key metrics, and each model's ten most important features from an importance table
    that SQL can make too (coefficients of variation, weighted by place and model)."""
    from ..sources import sinks
    pol = policies(spark, sf)
    fe = feat.engineer(pol)[0]
    row = fe.agg(*[F.avg(F.col(c).cast("double")).alias(f"a{c}") for c in _A7_COLUMNS],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{c}") for c in _A7_COLUMNS])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("feature"), F.round(F.col(f"s{c}") / F.col(f"a{c}") / (1 + (i + k) % 5), 6).alias("importance"))
                                          for k, m in enumerate(MODELS) for i, c in enumerate(_A7_COLUMNS)])).alias("r")).select("r.*")
    s = sinks.summary_table(ev.metric_rows(src.long_scores(src.scored_from(pol))), long, ev.KEY_METRICS)
    return s.withColumn("value", r9("value"))


@query("m01_alignment_check", sql("""
a AS (SELECT IDpol, ClaimNb FROM policies)""", """
p AS (SELECT IDpol, predicted_poisson FROM scored)""", """
SELECT CAST(count(CASE WHEN a.IDpol IS NOT NULL AND p.IDpol IS NOT NULL THEN 1 END) AS BIGINT) AS n_matched,
       CAST(count(CASE WHEN p.IDpol IS NULL THEN 1 END) AS BIGINT) AS n_missing_prediction,
       CAST(count(CASE WHEN a.IDpol IS NULL THEN 1 END) AS BIGINT) AS n_missing_actual
FROM a FULL OUTER JOIN p ON a.IDpol = p.IDpol"""))
def q_alignment(spark, sf):
    pol = policies(spark, sf)
    _, check = ev.align(pol.select("IDpol", "ClaimNb"), src.scored_from(pol).select("IDpol", "predicted_poisson"))
    return check
