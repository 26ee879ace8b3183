"""Registered queries on inputs with NaN, infinities and nulls put in by a key rule
(IDpol modulo 97) on both sides, with the distributed paths forced, and closed forms of
operators that the other queries use only inside a model."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite_or_null, nan_to_num
from ..operators import eda
from ..operators import evaluate as ev
from ..operators import features as feat
from ..operators import glm, ordering
from ..operators import profile as prof
from ..operators import ranking as rk
from ..operators import target as tg
from ..session import materialize, scratch_root
from ..sources import sinks
from ..sources import tables as src
from . import oracle_sql as O
from .catalog import FEATURE_COLUMNS, query


def with_bad_rows(df: DataFrame, cols, kinds=("nan", "inf", "-inf", None), key: str = "IDpol") -> DataFrame:
    """Row values replaced where the key modulo 97 is 0, 1, ...: one kind each."""
    out = {}
    for c in cols:
        value = F.col(c).cast("double")
        for i, kind in enumerate(kinds):
            value = F.when(F.col(key) % 97 == i, F.lit(None if kind is None else float(kind)).cast("double")).otherwise(value)
        out[c] = value
    return df.withColumns(out)


def bad_sql(c: str, kinds=("nan", "inf", "-inf", None), key: str = "IDpol") -> str:
    whens = " ".join(f"WHEN {key} % 97 = {i} THEN " + ("NULL" if k is None else f"'{k}'::DOUBLE") for i, k in enumerate(kinds))
    return f"CASE {whens} ELSE CAST({c} AS DOUBLE) END"


_COLS = ["Density", "Exposure", "BonusMalus"]
_SKIPPED = ("nan", None)
_BAD = ", bad AS (SELECT IDpol, " + ", ".join(f"{bad_sql(c)} AS {c}" for c in _COLS) + " FROM policies) "
_GAPS = ", gaps AS (SELECT IDpol, " + ", ".join(f"{bad_sql(c, _SKIPPED)} AS {c}" for c in _COLS) + " FROM policies), " \
    "g AS (SELECT IDpol, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in _COLS) + " FROM gaps) "


def _policies(spark, sf, kinds=("nan", "inf", "-inf", None)):
    return with_bad_rows(src.policies(spark, sf).select("IDpol", *_COLS), _COLS, kinds)


def _with(text: str) -> str:
    """The policies CTE, ready for more CTEs after it."""
    return O.POLICIES.rstrip() + text


@query("a04_inf_profile_injected", _with(_BAD) + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(CASE WHEN abs({c}) = 'inf'::DOUBLE THEN 1 END) AS BIGINT) AS n_inf FROM bad" for c in _COLS))
def q_inf(spark, sf):
    """A4 on rows with infinities."""
    return prof.inf_profile(_policies(spark, sf))


@query("d08_nan_to_num_injected", _with(_BAD) + "SELECT IDpol, " + ", ".join(
    f"CASE WHEN isnan({c}) THEN 0 WHEN {c} = 'inf'::DOUBLE THEN 1e10 WHEN {c} = '-inf'::DOUBLE THEN -1e10 ELSE {c} END AS {c}" for c in _COLS) + " FROM bad")
def q_nan_to_num(spark, sf):
    """D8 where its branches fire."""
    return _policies(spark, sf).select("IDpol", *[nan_to_num(c).alias(c) for c in _COLS])


def _describe_sql() -> str:
    return _with(_GAPS) + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, "
        f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM g" for c in _COLS)


def _described(spark, sf, limit):
    d = prof.describe(_policies(spark, sf, _SKIPPED), _COLS, max_buffered_distinct=limit)
    return d.select("variable", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75")])


@query("f04_describe_injected", _describe_sql())
def q_describe(spark, sf):
    """F4 skips NaN and null, buffered path."""
    return _described(spark, sf, 200_000)


@query("f04_describe_injected_distributed", _describe_sql())
def q_describe_distributed(spark, sf):
    """F4 skips NaN and null, distributed path."""
    return _described(spark, sf, 0)


@query("f12_quantiles_injected_distributed", _with(_GAPS) + " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(Density, {p}), 6) AS quantile FROM g" for p in (0.01, 0.5, 0.99)))
def q_quantiles(spark, sf):
    """F12 on the distributed path."""
    return ordering.exact_quantiles(_policies(spark, sf, _SKIPPED), "Density", [0.01, 0.5, 0.99], method="distributed").select("prob", F.round("quantile", 6).alias("quantile"))


_LONG = O.SCORED.rstrip() + ", bad AS (SELECT model, IDpol, actual, " + bad_sql("predicted") + " AS predicted FROM long_scores) "


def _scores(spark, sf):
    return with_bad_rows(src.long_scores(src.scored(spark, sf)), ["predicted"])


@query("c03_finite_pairs_injected", _LONG + "SELECT model, CAST(count(CASE WHEN predicted IS NOT NULL AND isfinite(predicted) THEN 1 END) AS BIGINT) AS n_valid, "
       "CAST(count(CASE WHEN predicted IS NULL OR NOT isfinite(predicted) THEN 1 END) AS BIGINT) AS n_removed FROM bad GROUP BY model")
def q_finite_pairs(spark, sf):
    """C3 where pairs are removed."""
    return rk.finite_pair_counts(_scores(spark, sf))


_THRESHOLD_SQL = _LONG + (
    ", s AS (SELECT model, count(*) AS n, avg(CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END) AS rate, "
    "quantile_cont(CASE WHEN actual > 0 THEN CAST(actual AS DOUBLE) END, 0.999) * 1.5 AS cap FROM bad GROUP BY model), "
    "v AS (SELECT b.model, b.predicted AS x, row_number() OVER (PARTITION BY b.model ORDER BY b.predicted) - 1 AS i, count(*) OVER (PARTITION BY b.model) AS k "
    "FROM bad b WHERE b.predicted IS NOT NULL AND NOT isnan(b.predicted)), "
    "q AS (SELECT v.model, any_value((k - 1) * (1 - s.rate)) AS pos, max(CASE WHEN i = floor((k - 1) * (1 - s.rate)) THEN x END) AS lo, "
    "max(CASE WHEN i = ceil((k - 1) * (1 - s.rate)) THEN x END) AS hi FROM v JOIN s ON s.model = v.model GROUP BY v.model) "
    "SELECT s.model, CAST(s.n AS BIGINT) AS n, round(s.rate, 9) AS claim_rate, round(s.cap, 6) AS cap, "
    "round(CASE WHEN q.lo = q.hi THEN q.lo ELSE (ceil(q.pos) - q.pos) * q.lo + (q.pos - floor(q.pos)) * q.hi END, 6) AS threshold FROM s JOIN q ON q.model = s.model")


def _scalar_row(spark, sf):
    return ev.scalars(_scores(spark, sf)).select("model", "n", F.round("claim_rate", 9).alias("claim_rate"), F.round("cap", 6).alias("cap"),
                                                 F.round("threshold", 6).alias("threshold"))


@query("m10_threshold_injected", _THRESHOLD_SQL)
def q_scalars(spark, sf):
    """M2/M10 scalars where predictions hold NaN (skipped), nulls (skipped) and infinities (kept)."""
    return _scalar_row(spark, sf)


@query("m10_threshold_injected_distributed", _THRESHOLD_SQL)
def q_scalars_distributed(spark, sf):
    """The same with nothing buffered."""
    before, ev.MAX_BUFFERED_DISTINCT = ev.MAX_BUFFERED_DISTINCT, 0
    try:
        return materialize(_scalar_row(spark, sf), "scalars")
    finally:
        ev.MAX_BUFFERED_DISTINCT = before


@query("m06_notebook_deviance_injected", _LONG + (
    ", s AS (SELECT model, quantile_cont(CASE WHEN actual > 0 THEN CAST(actual AS DOUBLE) END, 0.999) * 1.5 AS cap FROM bad GROUP BY model), "
    "d AS (SELECT b.model, CASE WHEN isnan(predicted) THEN predicted ELSE greatest(least(predicted, s.cap), 1e-10) END AS p, greatest(CAST(actual AS DOUBLE), 1e-10) AS y "
    "FROM bad b JOIN s ON s.model = b.model WHERE predicted IS NOT NULL), "
    "t AS (SELECT model, CASE WHEN isnan(p) THEN 0 ELSE 2 * (y * ln(y / p) - (y - p)) END AS dev FROM d) "
    "SELECT model, round(avg(least(dev, 1e6)), 6) AS poisson_deviance_nb FROM t GROUP BY model"))
def q_notebook_deviance(spark, sf):
    """M6 notebook deviance: a NaN prediction counts 0 (D8), not as the cap."""
    long = _scores(spark, sf).where("predicted IS NOT NULL")
    return ev.notebook_metrics(long).select("model", F.round("poisson_deviance_nb", 6).alias("poisson_deviance_nb"))


_CORR = ["Density", "Exposure", "BonusMalus", "DrivAge"]


@query("f09_correlation_injected", _with(", gaps AS (SELECT IDpol, " + ", ".join(f"{bad_sql(c, k)} AS {c}" for c, k in zip(_CORR, [("nan", None), (None, "nan", "nan"), ("nan",), ()]))
       + " FROM policies), g AS (SELECT " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in _CORR) + " FROM gaps) ").replace("CASE  ELSE", "CASE WHEN FALSE THEN NULL ELSE")
       + " UNION ALL ".join(f"SELECT '{_CORR[i]}' AS var_x, '{_CORR[j]}' AS var_y, round(corr({_CORR[i]}, {_CORR[j]}), 9) AS corr FROM g" for i in range(4) for j in range(i)))
def q_correlation(spark, sf):
    """F9 where NaN and nulls differ from column to column: each pair over its complete rows."""
    df = src.policies(spark, sf).select("IDpol", *_CORR)
    for c, kinds in zip(_CORR, [("nan", None), (None, "nan", "nan"), ("nan",), ()]):
        df = with_bad_rows(df, [c], kinds)
    return prof.correlation_pairs(df, _CORR).select("var_x", "var_y", F.round("corr", 9).alias("corr"))


_WHOLE = ["DrivAge", "BonusMalus", "VehPower"]


@query("f15_kde_unbinned", _with(", lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM policies WHERE {c} IS NOT NULL" for c in _WHOLE) + "), "
       "st AS (SELECT variable, min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM lg GROUP BY 1) ")
       + "SELECT lg.variable, CAST(g.i AS INT) AS grid_index, round(any_value(lo + (hi - lo) * g.i / 199.0), 6) AS x, "
       "round(sum(exp(-0.5 * pow((lo + (hi - lo) * g.i / 199.0 - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density "
       "FROM lg JOIN st USING (variable) CROSS JOIN range(200) g(i) GROUP BY lg.variable, g.i")
def q_kde(spark, sf):
    """F15 against the kernel sum over all rows: whole-numbered variables, a node at every value."""
    k = eda.kde_linear(eda.to_long(src.policies(spark, sf), _WHOLE), step=1.0)
    return k.select("variable", F.col("grid_index").cast("int").alias("grid_index"), F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("d02_blank_non_finite", _with(_BAD) + "SELECT IDpol, " + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in _COLS) + " FROM bad")
def q_blank(spark, sf):
    """NaN and infinities become null."""
    return _policies(spark, sf).select("IDpol", *[finite_or_null(c).alias(c) for c in _COLS])


@query("a06_csv_sink", O.POLICIES + "SELECT IDpol, ClaimNb, Exposure, VehPower, VehAge, DrivAge, BonusMalus, Density FROM policies")
def q_csv(spark, sf):
    """Rows written as CSV with a header and read back."""
    p = src.policies(spark, sf).select("IDpol", "ClaimNb", "Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density")
    path = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(p, path)
    return spark.read.schema(p.schema).option("header", True).csv(path)


_MODEL_COLUMNS = [c for c in FEATURE_COLUMNS if c not in ("IDpol", "ClaimNb")]


def _coded(c: str) -> str:
    if c == "BM_Segment":
        return ("CASE BM_Segment WHEN 'Base (50)' THEN 0 WHEN 'Moderate (51-75)' THEN 1 WHEN 'High (76-100)' THEN 2 WHEN 'Very High (>100)' THEN 3 ELSE -1 END")
    return "CASE RiskSegment WHEN 'High' THEN 0 WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE -1 END" if c == "RiskSegment" else c


@query("l07_model_matrix", O.FEATURES + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, round(avg(CAST({_coded(c)} AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST({_coded(c)} AS DOUBLE)), 6) AS sd FROM features"
    for i, c in enumerate(_MODEL_COLUMNS)))
def q_matrix(spark, sf):
    """C6 + L7: the 51 assembled inputs, without key and target, in their order, with the mean and
    sd of each place of the assembled vector."""
    frame = glm.model_frame(feat.engineer(src.policies(spark, sf))[0])
    cols = feat.model_columns(frame)
    vectors = glm.assembler(cols, "v").transform(frame).select(vector_to_array("v").alias("v"))
    at = [F.col("v")[i] for i in range(len(cols))]
    row = vectors.agg(F.array(*[F.avg(c) for c in at]).alias("m"), F.array(*[F.stddev_pop(c) for c in at]).alias("s"))
    return row.select(F.posexplode(F.arrays_zip("m", "s")).alias("position", "x")).select(
        F.col("position").cast("int").alias("position"), F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("position") + 1).alias("column_name"),
        F.round("x.m", 6).alias("mean"), F.round("x.s", 6).alias("sd"))


@query("l04_to_counts", O.POLICIES + "SELECT IDpol, round(least(ClaimNb / 2.0, 1.0) * greatest(Exposure, 0.05), 9) AS n, "
       "round(greatest(least(ClaimNb - 1.0, 1.0) * greatest(Exposure, 0.05), 0.0), 9) AS n_tweedie FROM policies")
def q_to_counts(spark, sf):
    """L4: rates to counts."""
    p, adj = src.policies(spark, sf), F.greatest(F.col("Exposure"), F.lit(tg.MIN_EXPOSURE))
    return p.select("IDpol", F.round(tg.to_counts(F.col("ClaimNb") / 2.0, adj), 9).alias("n"),
                    F.round(tg.to_counts(F.col("ClaimNb") - 1.0, adj, nonnegative=True), 9).alias("n_tweedie"))


@query("k06_missing_exposure", O.POLICIES + "SELECT IDpol, 1.0::DOUBLE AS exposure_adj, 0.0::DOUBLE AS offset_, CAST(ClaimNb AS DOUBLE) AS target FROM policies")
def q_missing_exposure(spark, sf):
    """K6: no exposure column."""
    p = src.policies(spark, sf).drop("Exposure")
    out = tg.TargetPrep.fit(p).transform(p)
    return out.select("IDpol", "exposure_adj", F.col("offset").alias("offset_"), "target")
