"""Cleaning (D1-D4) and the 41 derived risk columns.

Fitted state (category codes, fill values, density thresholds) is computed
once with a few aggregate jobs and then applied as plain column expressions,
so the same state scores new batches or a stream.

Order follows the reference: encode categories, flag very short exposure,
log/bin density, blank non-finite doubles, fill nulls per column, then derive
the remaining columns using whole-data density mean and 0.9 quantile.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import finite_or_null, flag
from ..session import materialize, parallelism, run_parallel
from ..sources.tables import CATEGORICAL
from .ordering import exact_quantiles, global_row_number
from .selection import is_scan

# Bin edges, labels and weights from the reference.
MIN_EXPOSURE = 0.05
DENSITY_EDGES = [0, 50, 200, 500, 1000, 5000]          # right-closed; above 5000 -> 5
BM_SEGMENT_EDGES = [0, 50, 75, 100]                    # right-closed; above 100 -> last label
BM_SEGMENT_LABELS = ["Base (50)", "Moderate (51-75)", "High (76-100)", "Very High (>100)"]
RISK_SEGMENT_CODES = {"High": 0, "Low": 1, "Medium": 2}   # lexical category codes
COMPOSITE_WEIGHTS = {"VeryHighPower": 3, "YoungDriverHighPower": 5, "HighRiskBM": 4, "TeenDriver": 3,
                     "VeryOldVehicle": 2, "VeryShortExposure": 4, "DenseArea": 2}

# vocabularies up to this size are ranked in one window per column and broadcast
MAX_SMALL_VOCAB = 100_000


# ---------------------------------------------------------------- D1 / D6
def fit_codes(df: DataFrame, cols=CATEGORICAL, order: str = "sorted", key: str = "IDpol",
              vocab_estimate: int | None = None) -> DataFrame:
    """Code table (column_name, value, code), materialised once.

    order="sorted": codes 0..k-1 in sorted value order over the whole data
    (label encoding; a null value gets the last code).
    order="first":  codes by first appearance, "first" meaning lowest ``key``
    (factorize; Spark rows have no order of their own).

    ``vocab_estimate`` (largest distinct count of one column, e.g. from
    ``approx_count_distinct``) picks the plan; without it one count job runs.
    """
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"),
                      (F.col(key) if order == "first" else F.lit(0)).cast("long").alias("_first")) for c in cols]
    long = df.select(F.explode(F.array(*parts)).alias("kv")).select("kv.*")
    vocab = long.groupBy("column_name", "value").agg(F.min("_first").alias("_first"))
    sort_key = [F.col("value").asc_nulls_last()] if order == "sorted" else [F.col("_first"), F.col("value")]
    if vocab_estimate is None:
        vocab = materialize(vocab, "vocab")
        vocab_estimate = vocab.groupBy("column_name").count().agg(F.max("count")).first()[0] or 0
    if vocab_estimate <= MAX_SMALL_VOCAB:
        # checked bound: each per-column window holds at most MAX_SMALL_VOCAB rows
        w = Window.partitionBy("column_name").orderBy(*sort_key)
        codes = vocab.select("column_name", "value", (F.row_number().over(w) - 1).cast("int").alias("code"))
    else:
        ranked = global_row_number(vocab, [F.col("column_name"), *sort_key], out="_rn")
        start = ranked.groupBy("column_name").agg(F.min("_rn").alias("_start"))
        # broadcast bound: one row per encoded column
        codes = ranked.join(F.broadcast(start), "column_name").select(
            "column_name", "value", (F.col("_rn") - F.col("_start")).cast("int").alias("code"))
    return materialize(codes, "codes")


def apply_codes(df: DataFrame, codes: DataFrame, cols=CATEGORICAL, suffix: str = "",
                small: bool | None = None) -> DataFrame:
    """Replace (or add with ``suffix``) each category column by its code.

    Broadcast only when the code table passed the vocabulary size check;
    otherwise a shuffle join (AQE splits a hot value)."""
    if small is None:
        small = codes.count() <= len(cols) * MAX_SMALL_VOCAB
    out = df
    for c in cols:
        m = codes.where(F.col("column_name") == c).select(F.col("value").alias(f"_v_{c}"),
                                                         F.col("code").alias(f"_c_{c}"))
        m = F.broadcast(m) if small else m
        out = out.join(m, out[c].cast("string").eqNullSafe(m[f"_v_{c}"]), "left")
    # a value unseen when the codes were fitted (new data, a stream) gets -1
    code = lambda c: F.coalesce(F.col(f"_c_{c}"), F.lit(-1))
    sel = []
    for name in df.columns:
        if name in cols and not suffix:
            sel.append(code(name).alias(name))
        else:
            sel.append(F.col(name))
    if suffix:
        sel += [code(c).alias(f"{c}{suffix}") for c in cols]
    return out.select(*sel)


# ---------------------------------------------------------------- B1-B3
def density_group(d: Column) -> Column:
    e = DENSITY_EDGES
    return (F.when(d.isNull() | (d <= e[0]), F.lit(None).cast("int"))
             .when(d <= e[1], 0).when(d <= e[2], 1).when(d <= e[3], 2)
             .when(d <= e[4], 3).when(d <= e[5], 4).otherwise(5))


def base_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "VeryShortExposure": flag(F.col("Exposure") < MIN_EXPOSURE),
        "LogDensity": F.log1p(F.col("Density")),
        "DensityGroup": density_group(F.col("Density")),
    })


# ---------------------------------------------------------------- D2-D4
def blank_non_finite(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite_or_null(c) for c in doubles}) if doubles else df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fit_fill_values(df: DataFrame, strategy: str = "median", exact: bool = True) -> dict[str, float]:
    """One pass for null counts; a second for the fill statistic of the
    columns that have nulls (exact median via ``exact_quantiles``)."""
    cols = numeric_columns(df)
    if not cols:
        return {}
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first().asDict()
    todo = [c for c in cols if nulls[c] > 0]
    if not todo:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in todo]).first().asDict()
        return {c: row[c] for c in todo}
    if strategy != "median":
        raise ValueError(strategy)
    fills = {}
    for c in todo:
        q = exact_quantiles(df, c, [0.5], method="auto" if exact else "approx").collect()
        fills[c] = q[0]["quantile"] if q else None
    return fills


def apply_fill(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if v is not None}) \
        if fills else df


@dataclass
class CleanState:
    codes: DataFrame
    fills: dict[str, float] = field(default_factory=dict)
    vocab_small: bool = True


def _profile_input(df: DataFrame, cols=CATEGORICAL) -> dict:
    """One job: vocabulary estimates, and null counts + distinct estimates of
    the numeric columns as they will look after B1-B3 and D2."""
    staged = blank_non_finite(base_columns(df))
    nums = [c for c in numeric_columns(staged) if c not in cols]
    row = staged.agg(*[F.approx_count_distinct(c).alias(f"d\u0001{c}") for c in [*cols, *nums]],
                     *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n\u0001{c}") for c in nums]).first().asDict()
    return {"vocab": max([row[f"d\u0001{c}"] for c in cols] or [0]),
            "distinct": {c: row[f"d\u0001{c}"] for c in nums},
            "nulls": {c: row[f"n\u0001{c}"] for c in nums}}


def _fit_fills_and_density(staged: DataFrame, prof: dict, impute: str,
                           max_buffered: int = 200_000) -> tuple[dict, "DensityThresholds | None"]:
    """One aggregate for every fill statistic and, when Density needs no fill,
    the density thresholds too; very high-cardinality columns go through the
    distributed exact quantile instead of the buffered one."""
    todo = [c for c, n in prof["nulls"].items() if n > 0]
    with_density = "Density" not in todo and "Density" in prof["distinct"]
    aggs, later = [], []
    for c in todo:
        if impute == "mean":
            aggs.append(F.avg(c).alias(c))
        elif prof["distinct"][c] <= max_buffered:
            aggs.append(F.percentile(F.col(c).cast("double"), 0.5).alias(c))
        else:
            later.append(c)
    if with_density:
        aggs.append(F.avg("Density").alias("\u0001mean"))
        if prof["distinct"]["Density"] <= max_buffered:
            aggs.append(F.percentile(F.col("Density").cast("double"), 0.9).alias("\u0001q90"))
    row = staged.agg(*aggs).first().asDict() if aggs else {}
    fills = {c: row[c] for c in todo if c in row}
    for c in later:
        q = exact_quantiles(staged, c, [0.5], method="distributed").first()
        fills[c] = q["quantile"] if q else None
    th = None
    if with_density:
        q90 = row.get("\u0001q90")
        if q90 is None:
            q = exact_quantiles(staged, "Density", [0.9], method="distributed").first()
            q90 = q["quantile"] if q else None
        th = DensityThresholds(row["\u0001mean"], q90)
    return fills, th


def clean(df: DataFrame, impute: str = "median", codes: DataFrame | None = None,
          fills: dict | None = None, vocab_small: bool | None = None) -> tuple[DataFrame, CleanState]:
    """load_and_preprocess: D1 codes -> B1-B3 -> D2 -> D3/D4 (fitted unless given). What is fitted takes several
    passes, so rows that come from joins or aggregates are written once before."""
    if (codes is None or fills is None) and not is_scan(df):
        df = materialize(df, "policies", min_partitions=parallelism(df.sparkSession))
    if codes is None:
        prof = _profile_input(df)
        codes = fit_codes(df, vocab_estimate=prof["vocab"])
        small = prof["vocab"] <= MAX_SMALL_VOCAB
    else:
        small = vocab_small
    out = blank_non_finite(base_columns(apply_codes(df, codes, small=small)))
    if fills is None:
        fills = fit_fill_values(out, impute)
    return apply_fill(out, fills), CleanState(codes, fills, bool(small) if small is not None else True)


# ---------------------------------------------------------------- B4-B41
@dataclass
class DensityThresholds:
    mean: float
    q90: float


def fit_density_thresholds(df: DataFrame) -> DensityThresholds:
    """mean and 0.9 quantile of Density (whole-data statistics)."""
    mean = df.agg(F.avg("Density").alias("m")).first()["m"]
    q = exact_quantiles(df, "Density", [0.9]).first()
    return DensityThresholds(mean, q["quantile"] if q else None)


def _g(x: str) -> str:
    """g(x) = max(x, 1), null-propagating like np.maximum (Spark's greatest skips nulls)."""
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE greatest({x}, 1) END)"


def _flag(cond: str) -> str:
    """bool -> 0/1; a null comparison counts as 0 (pandas compares NaN as False)."""
    return f"coalesce(CAST(({cond}) AS INT), 0)"


def _dlit(x) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"CAST('{float(x)!r}' AS DOUBLE)"


def _bm_segment_sql(bm: str = "BonusMalus") -> str:
    e, lab = BM_SEGMENT_EDGES, BM_SEGMENT_LABELS
    return (f"CASE WHEN {bm} IS NULL OR {bm} <= {e[0]} THEN CAST(NULL AS STRING) "
            f"WHEN {bm} <= {e[1]} THEN '{lab[0]}' WHEN {bm} <= {e[2]} THEN '{lab[1]}' "
            f"WHEN {bm} <= {e[3]} THEN '{lab[2]}' ELSE '{lab[3]}' END")


def derive(df: DataFrame, th: DensityThresholds, variant: str = "module") -> DataFrame:
    """B4-B41 as SQL expressions in four ``selectExpr`` layers (each layer uses
    the previous one's columns); Catalyst collapses them into one projection.
    One call per layer keeps driver-side plan building cheap."""
    w = COMPOSITE_WEIGHTS
    layer1 = {
        "LogExposure": "log1p(Exposure)",
        "VehAge_DrivAge_Ratio": f"VehAge / {_g('DrivAge')}",
        "NewVehicle": _flag("VehAge <= 1"),
        "YoungVehicle": _flag("VehAge > 1 AND VehAge <= 3"),
        "MatureVehicle": _flag("VehAge > 3 AND VehAge <= 10"),
        "OldVehicle": _flag("VehAge > 10"),
        "VeryOldVehicle": _flag("VehAge > 15"),
        "TeenDriver": _flag("DrivAge >= 18 AND DrivAge < 21"),
        "YoungDriver": _flag("DrivAge >= 21 AND DrivAge < 25"),
        "AdultDriver": _flag("DrivAge >= 25 AND DrivAge < 65"),
        "SeniorDriver": _flag("DrivAge >= 65"),
        "DrivExperience": "greatest(DrivAge - 18, 0)",
    }
    layer2 = {
        "VeryNoviceDriver": _flag("DrivExperience <= 1"),
        "NoviceDriver": _flag("DrivExperience > 1 AND DrivExperience <= 3"),
        "ModerateExperienceDriver": _flag("DrivExperience > 3 AND DrivExperience <= 10"),
        "ExperiencedDriver": _flag("DrivExperience > 10"),
        "PowerToExperience": f"VehPower / {_g('DrivExperience')}",
        "LowPower": _flag("VehPower <= 5"),
        "MediumPower": _flag("VehPower > 5 AND VehPower <= 8"),
        "HighPower": _flag("VehPower > 8 AND VehPower <= 10"),
        "VeryHighPower": _flag("VehPower > 10"),
        "YoungDriverHighPower": _flag("DrivAge < 25 AND VehPower > 8"),
        "NewDriverNewCar": _flag("DrivExperience <= 3 AND VehAge <= 3"),
        "InexperiencePowerRatio": f"VehPower / {_g('DrivExperience')}",
        "BM_Exp": "exp((BonusMalus - 50) / 50)",
        "BM_Power": "BonusMalus * VehPower",
        "BM_Age": f"BonusMalus / {_g('DrivAge')}",
        "HighRiskBM": _flag("BonusMalus > 100"),
        "ModerateRiskBM": _flag("BonusMalus > 50 AND BonusMalus <= 100"),
        "LowRiskBM": _flag("BonusMalus = 50"),
        "BM_Segment": _bm_segment_sql(),
        "HighDensityBM": _flag(f"Density > {_dlit(th.mean)} AND BonusMalus > 75"),
    }
    score = (f"VeryHighPower * {w['VeryHighPower']} + YoungDriverHighPower * {w['YoungDriverHighPower']}"
             f" + HighRiskBM * {w['HighRiskBM']} + TeenDriver * {w['TeenDriver']}"
             f" + VeryOldVehicle * {w['VeryOldVehicle']} + VeryShortExposure * {w['VeryShortExposure']}"
             f" + {_flag(f'Density > {_dlit(th.q90)}')} * {w['DenseArea']}")
    denom = _g("DrivAge") if variant == "module" else "(DrivAge + 1)"
    layer3 = {
        "CompositeRiskScore": f"CAST({score} AS INT)",
        "RiskSegment": None,
        "RiskFactorScore": f"VehPower * BonusMalus / {denom}",
        "Area_Region": "Area * Region",
        "Brand_Gas": "VehBrand * VehGas",
        "VehAgePower": "VehAge * VehPower",
    }
    out = df.selectExpr("*", *[f"{v} AS {k}" for k, v in layer1.items()])
    out = out.selectExpr("*", *[f"{v} AS {k}" for k, v in layer2.items()])
    out = out.selectExpr("*", *[f"{v} AS {k}" for k, v in layer3.items() if v is not None])
    segment = "CASE WHEN CompositeRiskScore >= 4 THEN 'High' WHEN CompositeRiskScore = 0 THEN 'Low' ELSE 'Medium' END"
    tail = [k for k in layer3 if k not in ("CompositeRiskScore", "RiskSegment")]
    head = [c for c in out.columns if c not in tail]
    return out.selectExpr(*[f"`{c}`" for c in head], f"{segment} AS RiskSegment", *[f"`{c}`" for c in tail])


@dataclass
class FeatureState:
    clean: CleanState
    density: DensityThresholds
    variant: str = "module"


def engineer(pol: DataFrame, impute: str = "median", variant: str = "module",
             state: FeatureState | None = None, stage: bool = True) -> tuple[DataFrame, FeatureState]:
    """Whole §3.1 feature build: 12 inputs -> 53 columns.

    Fitting stages the (possibly join-derived) input once in the checkpoint
    folder, then needs three light jobs: a profile (vocabulary sizes, null
    counts), the code table, and one aggregate with every fill value and the
    density thresholds. With ``state`` the fitted values are reused (scoring
    new data, streams) and no job runs."""
    if state is not None:
        cleaned, _ = clean(pol, impute, state.clean.codes, state.clean.fills, state.clean.vocab_small)
        return derive(cleaned, state.density, state.variant), state
    base = materialize(pol, "policies", min_partitions=parallelism(pol.sparkSession)) if stage else pol
    prof = _profile_input(base)
    small = prof["vocab"] <= MAX_SMALL_VOCAB
    # code table and fill statistics are independent (code columns hold no
    # nulls), so their jobs run concurrently
    fitted = run_parallel({
        "codes": lambda: fit_codes(base, vocab_estimate=prof["vocab"]),
        "fills": lambda: _fit_fills_and_density(blank_non_finite(base_columns(base)), prof, impute)})
    codes, (fills, th) = fitted["codes"], fitted["fills"]
    staged = blank_non_finite(base_columns(apply_codes(base, codes, small=small)))
    cleaned = apply_fill(staged, fills)
    if th is None:
        th = fit_density_thresholds(cleaned)
    state = FeatureState(CleanState(codes, fills, small), th, variant)
    return derive(cleaned, th, variant), state


# ---------------------------------------------------------------- D5 / L7
def segment_codes(df: DataFrame, risk: bool = True) -> DataFrame:
    """BM_Segment in bin order 0..3, RiskSegment lexical; unknown -> -1.
    ``risk=False`` leaves RiskSegment as it is (already coded another way)."""
    bm = F.lit(-1)
    for i, lab in reversed(list(enumerate(BM_SEGMENT_LABELS))):
        bm = F.when(F.col("BM_Segment") == lab, i).otherwise(bm)
    rs = F.lit(-1)
    for lab, i in RISK_SEGMENT_CODES.items():
        rs = F.when(F.col("RiskSegment") == lab, i).otherwise(rs)
    if not risk:
        return df.withColumn("BM_Segment", bm.cast("int"))
    return df.withColumns({"BM_Segment": bm.cast("int"), "RiskSegment": rs.cast("int")})


DROP_FOR_MODEL = ["ClaimNb", "IDpol"]


def model_columns(features: DataFrame) -> list[str]:
    """The 51 model inputs (C6: drop id/target, tolerant of absence)."""
    return [c for c in features.columns if c not in DROP_FOR_MODEL]
