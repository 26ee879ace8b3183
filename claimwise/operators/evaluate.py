"""Model evaluation (M1-M15), comparison (I2-I3), error analysis (E1, E2,
H2, H6) over long-form scores ``(model, IDpol, actual, predicted)``.

The metric row is three passes whatever the number of models:
1. per-model scalars: claim rate and the prediction cap
   (1.5 x p99.9 of positive actuals, 10 without positives);
2. the detection threshold: percentile of predictions at 1 - claim rate
   (data-dependent probability, so a second pass);
3. one aggregate with every conditional sum, the scalars broadcast
   (one row per model).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null, poisson_deviance_term
from ..session import materialize, run_parallel
from . import selection
from .ordering import exact_quantiles

# Metric names of the comparison, model order for ties.
KEY_METRICS = ["rmse", "mae", "r2", "poisson_deviance", "f1"]
MODEL_ORDER = {"standard": 0, "poisson": 1, "tweedie": 2}
METRIC_COLUMNS = ["rmse", "mae", "r2", "poisson_deviance", "low_rmse", "low_mae", "medium_rmse", "medium_mae",
                  "high_rmse", "high_mae", "accuracy", "precision", "recall", "f1", "threshold"]


def align(actuals: DataFrame, predictions: DataFrame, key: str = "IDpol") -> tuple[DataFrame, DataFrame]:
    """M1: pair actuals with predictions by key (never by position). Returns
    the matched rows and a one-row check (n_matched, n_missing_prediction,
    n_missing_actual); callers stop on a non-zero mismatch instead of
    evaluating misaligned vectors."""
    j = actuals.join(predictions, key, "full")
    pred_cols = [c for c in predictions.columns if c != key]
    act_cols = [c for c in actuals.columns if c != key]
    has_p = F.col(pred_cols[0]).isNotNull() if pred_cols else F.lit(True)
    has_a = F.col(act_cols[0]).isNotNull() if act_cols else F.lit(True)
    check = j.agg(F.count(F.when(has_p & has_a, 1)).cast("bigint").alias("n_matched"),
                  F.count(F.when(~has_p, 1)).cast("bigint").alias("n_missing_prediction"),
                  F.count(F.when(~has_a, 1)).cast("bigint").alias("n_missing_actual"))
    return j.where(has_p & has_a), check


class Misaligned(ValueError):
    """Actuals and predictions do not hold the same keys; ``report`` has one row per side."""

    def __init__(self, report: list[dict]):
        self.report = report
        super().__init__("; ".join(f"{r['n']} {r['side']}, first keys {r['first_keys']}" for r in report if r["n"]))


def mismatches(actuals: DataFrame, predictions: DataFrame, key: str = "IDpol", listed: int = 20, matched: bool = False) -> DataFrame:
    """M1: rows (side, n, first_keys) for ``missing_prediction``, ``missing_actual``, ``repeated_actual``
    and ``repeated_prediction`` keys: counts and the smallest ``listed`` keys, from keyed anti-joins and key
    counts. Null keys match nothing: each is missing on the other side."""
    a, p = (d.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("c")) for d in (actuals, predictions))
    sides = {"missing_prediction": a.join(p, "k", "left_anti"), "missing_actual": p.join(a, "k", "left_anti"),
             "repeated_actual": a.where((F.col("c") > 1) & F.col("k").isNotNull()), "repeated_prediction": p.where((F.col("c") > 1) & F.col("k").isNotNull())}
    out = None
    for side, keys in sides.items():
        # a list of ``listed`` keys at most: the first of each partition, then the first of those
        first = keys.where(F.col("k").isNotNull()).orderBy("k").limit(listed).agg(F.array_sort(F.collect_list("k")).alias("first_keys"))
        n = keys.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c")).otherwise(1)), F.lit(0)).cast("bigint").alias("n"))
        one = n.select(F.lit(side).alias("side"), "n", first.scalar().alias("first_keys"))
        out = one if out is None else out.unionByName(one)
    return out


def require_aligned(actuals: DataFrame, predictions: DataFrame, key: str = "IDpol", listed: int = 20) -> None:
    """Stops with ``Misaligned`` unless both sides hold the same keys, each once."""
    report = [r.asDict() for r in mismatches(actuals, predictions, key, listed).collect()]     # four rows
    if any(r["n"] for r in report):
        raise Misaligned(report)


MAX_BUFFERED_DISTINCT = 200_000
MAX_FUSED_GROUPS = 64


def scalars(long: DataFrame, group_cols: Sequence[str] = ("model",), actual: str = "actual",
            predicted: str = "predicted", default_cap: float = 10.0) -> DataFrame:
    """Passes 1-2: (group..., n, claim_rate, cap, threshold).

    Pass 1 (one aggregate): rows, claim rate and HyperLogLog distinct
    estimates per model. Pass 2 (one aggregate): every model's cap and
    threshold percentile as filtered ``percentile`` aggregates with the
    model's constant probability - each buffer holds one model's distinct
    values, bounded by the estimate check. Many models or high-cardinality
    scores use the distributed ``exact_quantiles`` path instead."""
    g = list(group_cols)
    y, p = nan_to_null(actual), nan_to_null(predicted)   # one rule for both paths: NaN and null are skipped
    first = long.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg((y > 0).cast("double")).alias("claim_rate"),
                                 F.approx_count_distinct(F.when(y > 0, y)).alias("_dpos"),
                                 F.approx_count_distinct(p).alias("_dpred"))
    rows = first.limit(MAX_FUSED_GROUPS + 1).collect()
    fused = (len(rows) <= MAX_FUSED_GROUPS and
             all(r["_dpos"] <= MAX_BUFFERED_DISTINCT and r["_dpred"] <= MAX_BUFFERED_DISTINCT for r in rows))
    if not fused:
        caps = exact_quantiles(long.where(y > 0), actual, [0.999], group_cols=g, method="distributed") \
            .select(*g, (F.col("quantile") * 1.5).alias("_cap"))
        probs = first.where(F.col("claim_rate") > 0).select(*g, (F.lit(1.0) - F.col("claim_rate")).alias("prob"))
        thr = exact_quantiles(long, predicted, probs, group_cols=g, method="distributed") \
            .select(*g, F.col("quantile").alias("_thr"))
        return first.join(caps, g, "left").join(thr, g, "left").select(
            *g, "n", "claim_rate", F.coalesce(F.col("_cap"), F.lit(default_cap)).alias("cap"),
            F.when(F.col("claim_rate") > 0, F.col("_thr")).otherwise(F.lit(0.5)).alias("threshold"))
    aggs = []
    for i, r in enumerate(rows):
        in_g = F.lit(True)
        for k in g:
            in_g = in_g & F.col(k).eqNullSafe(F.lit(r[k]))
        aggs.append(F.percentile(F.when(in_g & (y > 0), y.cast("double")), 0.999).alias(f"c{i}"))
        if r["claim_rate"] > 0:
            aggs.append(F.percentile(F.when(in_g, p.cast("double")), 1.0 - r["claim_rate"]).alias(f"t{i}"))
    q = long.agg(*aggs).first().asDict() if aggs else {}
    out = []
    for i, r in enumerate(rows):
        cap = q.get(f"c{i}")
        thr = q.get(f"t{i}") if r["claim_rate"] > 0 else 0.5
        out.append((*[r[k] for k in g], r["n"], r["claim_rate"], cap * 1.5 if cap is not None else default_cap, thr))
    schema = first.select(*g, "n", "claim_rate").schema.add("cap", "double").add("threshold", "double")
    return long.sparkSession.createDataFrame(out, schema)


#: Distinct actual values of a group that are counted on the driver.
MAX_ACTUALS = 10_000


def _class_conditions(y) -> dict:
    return {"low": y == 0, "medium": y == 1, "high": y > 1}


def _percentile(values: list[tuple], prob: float) -> float | None:
    """Linear interpolation over sorted (value, count) pairs."""
    n = sum(c for _, c in values)
    if not n:
        return None
    cells = [selection.Cell(1, float(v), c) for v, c in values]
    return selection.between(cells, n, prob)


def _selected_metrics(long: DataFrame, g: list[str], actual: str, predicted: str, default_cap: float = 10.0) -> DataFrame | None:
    """The metric rows in two rounds of jobs: value counts of the actuals beside a sketch of the
    predictions, then one aggregate that holds all sums by the cells around each threshold,
    so that the threshold and what lies above it follow from the same counts."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    known = nan_to_null(predicted)
    first = run_parallel({
        "actuals": lambda: long.groupBy(*g, y.alias("_y")).agg(F.count(F.lit(1)).alias("_n")).limit(MAX_ACTUALS + 1).collect(),
        "sketches": lambda: selection.sketches(long, known, g)})
    if first["sketches"] is None or len(first["actuals"]) > MAX_ACTUALS:
        return None
    sketch = {tuple(r[c] for c in g): (r["_n"], r["_grid"]) for r in first["sketches"]}
    if not sketch:
        return None
    facts, brackets = {}, {}
    for key, (n, grid) in sketch.items():
        values = sorted((r["_y"], r["_n"]) for r in first["actuals"] if tuple(r[c] for c in g) == key and r["_y"] is not None and not math.isnan(r["_y"]))
        rows = sum(r["_n"] for r in first["actuals"] if tuple(r[c] for c in g) == key)
        if sum(c for _, c in values) != rows:
            return None                      # missing actuals: the general path
        positive = [(v, c) for v, c in values if v > 0]
        rate = sum(c for _, c in positive) / rows
        top = _percentile(positive, 0.999)
        facts[key] = (values, rows, rate, top * 1.5 if top is not None else default_cap)
        at = [selection.bracket(n, grid, i) for i in selection.ranks_of(n, 1.0 - rate)] if rate > 0 and n else [(0.5, 0.5)]
        brackets[key] = selection.merged(at)
    group = F.col("_g")
    cap = selection.constant([f[3] for f in facts.values()], "array<double>")[group]
    index = F.when(p.isNull(), -2).when(F.isnan(p), -1).otherwise(selection.cell_index(known, group, list(brackets.values())))
    pc = F.when(F.isnan(p), p).otherwise(F.least(p, F.col("_cap")))   # NaN stays NaN: it is not scored as the cap
    e2, r2, ra = (y - pc) * (y - pc), (y - p) * (y - p), F.abs(y - p)
    dev = poisson_deviance_term(y, p, "module")
    sums = {"e2": F.sum(e2), "ea": F.sum(F.abs(y - pc)), "dev": F.sum(dev), "deviances": F.count(dev), "scored": F.count(p), "positive": F.count(F.when(y > 0, 1))}
    for name, cond in _class_conditions(y).items():
        sums[f"{name}2"], sums[f"{name}1"] = F.sum(F.when(cond, r2)), F.sum(F.when(cond, ra))
    tagged = long.withColumn("_g", selection.group_index(g, list(facts))).withColumns({"_cap": cap, "_i": index}).withColumn("_v", F.when((F.col("_i") >= 0) & (F.col("_i") % 2 == 1), known))
    cells = tagged.groupBy("_g", "_i", "_v").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_{k}") for k, c in sums.items()]).limit(selection.MAX_CELLS + 1).collect()
    if len(cells) > selection.MAX_CELLS:
        return None
    out = []
    for place, (key, (values, rows, rate, _)) in enumerate(facts.items()):
        mine = [r for r in cells if r["_g"] == place]
        order = sorted((r for r in mine if r["_i"] >= 0), key=lambda r: (r["_i"], r["_v"] if r["_v"] is not None else 0))
        n = sketch[key][0]
        threshold = 0.5 if not rate else selection.between([selection.Cell(r["_i"], r["_v"], r["_n"]) for r in order], n, 1.0 - rate) if n else None

        def total(name):
            found = [r[f"_{name}"] for r in mine if r[f"_{name}"] is not None]     # noqa: B023
            return math.fsum(found) if found and all(map(math.isfinite, found)) else sum(found) if found else None

        def ratio(a, b):
            return a / b if a is not None and b else None
        # a bracket holds the threshold; interval 2m lies between brackets m - 1 and m
        home = next((m for m, (lo, hi) in enumerate(brackets[key]) if threshold is not None and (lo is None or lo <= threshold) and (hi is None or threshold <= hi)), None)
        above = [r for r in order if home is not None and (r["_v"] > threshold if r["_v"] is not None else r["_i"] > 2 * home + 1)]
        tp = sum(r["_positive"] for r in above)
        fp = sum(r["_n"] for r in above) - tp
        fn = sum(r["_positive"] for r in mine if r["_i"] != -2) - tp if threshold is not None else 0
        mean = sum(v * c for v, c in values) / rows
        sst = sum(c * (v - mean) ** 2 for v, c in values)
        scored, e2_ = total("scored"), total("e2")
        count = {"low": sum(c for v, c in values if v == 0), "medium": sum(c for v, c in values if v == 1), "high": sum(c for v, c in values if v > 1)}
        root = lambda x: None if x is None else math.sqrt(x)
        by_class = [f(ratio(total(f"{k}{d}"), count[k])) for k in count for f, d in ((root, 2), (lambda x: x, 1))]
        precision, recall = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
        out.append((*key, root(ratio(e2_, scored)), ratio(total("ea"), scored), (None if e2_ is None else 1 - e2_ / sst) if sst > 1e-10 else 0.0, ratio(total("dev"), total("deviances")),
                    *by_class, (rows - fp - fn) / rows, precision, recall, 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0, threshold))
    schema = T.StructType([*[long.schema[c] for c in g], *[T.StructField(c, T.DoubleType()) for c in METRIC_COLUMNS]])
    return long.sparkSession.createDataFrame(out, schema)


def metric_rows(long: DataFrame, group_cols: Sequence[str] = ("model",), actual: str = "actual",
                predicted: str = "predicted", sc: DataFrame | None = None) -> DataFrame:
    """One wide row per model (module semantics). Up to the limits of ``selection`` in two
    rounds of jobs; with given scalars or beyond, by the passes of the module's text."""
    g = list(group_cols)
    if sc is None:
        long = long.select(*g, actual, predicted)
        if not selection.is_scan(long):
            long = materialize(long, "scores")       # read by several passes: computed once
        found = _selected_metrics(long, g, actual, predicted)
        if found is not None:
            return found
        sc = scalars(long, g, actual, predicted)
    # broadcast bound: one row per model
    j = long.join(F.broadcast(sc), g)
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    pc = F.when(F.isnan(p), p).otherwise(F.least(p, F.col("cap")))   # NaN stays NaN: it is not scored as the cap
    e2, ea = (y - pc) * (y - pc), F.abs(y - pc)
    r2, ra = (y - p) * (y - p), F.abs(y - p)
    pos_a, pos_p = y > 0, (p > F.col("threshold")) & ~F.isnan(p)

    def cls(cond, name):
        return [F.sqrt(F.sum(F.when(cond, r2)) / F.count(F.when(cond, 1))).alias(f"{name}_rmse"),
                (F.sum(F.when(cond, ra)) / F.count(F.when(cond, 1))).alias(f"{name}_mae")]

    a = j.groupBy(*g, "threshold").agg(
        F.sqrt(F.avg(e2)).alias("rmse"), F.avg(ea).alias("mae"),
        F.sum(e2).alias("_ssr"), (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.avg(poisson_deviance_term(y, p, "module")).alias("poisson_deviance"),
        *cls(y == 0, "low"), *cls(y == 1, "medium"), *cls(y > 1, "high"),
        F.count(F.when(pos_a & pos_p, 1)).alias("_tp"), F.count(F.when(~pos_a & pos_p, 1)).alias("_fp"),
        F.count(F.when(pos_a & ~pos_p, 1)).alias("_fn"), F.count(F.lit(1)).alias("_n"))
    tp, fp, fn, n = (F.col(c) for c in ("_tp", "_fp", "_fn", "_n"))
    prec = F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp))
    rec = F.when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn))
    return a.select(
        *g, "rmse", "mae",
        F.when(F.col("_sst") > 1e-10, 1 - F.col("_ssr") / F.col("_sst")).otherwise(F.lit(0.0)).alias("r2"),
        "poisson_deviance", "low_rmse", "low_mae", "medium_rmse", "medium_mae", "high_rmse", "high_mae",
        ((n - fp - fn) / n).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
        F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn)).alias("f1"),
        F.col("threshold").cast("double").alias("threshold"))


def class_metrics(long: DataFrame, group_cols: Sequence[str] = ("model",), actual: str = "actual",
                  predicted: str = "predicted") -> DataFrame:
    """M7: RMSE/MAE per actual class 0 / 1 / >1 on raw predictions; an absent
    class still gets its row, with nulls (right join to the class list)."""
    g = list(group_cols)
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    cls = F.when(y == 0, "low").when(y == 1, "medium").when(y > 1, "high")
    stats = long.groupBy(*g, cls.alias("risk_class")).agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        F.count(F.lit(1)).cast("bigint").alias("n"))
    frame = long.select(*g).distinct().select(*g, F.explode(F.array(*[F.lit(x) for x in ("low", "medium", "high")]))
                                              .alias("risk_class"))
    return frame.join(stats, [*g, "risk_class"], "left")


def notebook_metrics(long: DataFrame, group_cols: Sequence[str] = ("model",), actual: str = "actual",
                     predicted: str = "predicted") -> DataFrame:
    """M6 + M9: notebook deviance (capped input) and zero / non-zero RMSE, MAE."""
    g = list(group_cols)
    long = materialize(long.select(*g, actual, predicted), "scores")   # read by three passes: computed once
    sc = scalars(long, g, actual, predicted)
    # broadcast bound: one row per model
    j = long.join(F.broadcast(sc), g)
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    pc = F.when(F.isnan(p), p).otherwise(F.least(p, F.col("cap")))   # as in metric_rows: NaN is not scored as the cap
    r2, ra = (y - p) * (y - p), F.abs(y - p)
    return j.groupBy(*g).agg(
        F.avg(poisson_deviance_term(y, pc, "notebook")).alias("poisson_deviance_nb"),
        F.sqrt(F.sum(F.when(y == 0, r2)) / F.count(F.when(y == 0, 1))).alias("zero_rmse"),
        (F.sum(F.when(y == 0, ra)) / F.count(F.when(y == 0, 1))).alias("zero_mae"),
        F.sqrt(F.sum(F.when(y > 0, r2)) / F.count(F.when(y > 0, 1))).alias("nonzero_rmse"),
        (F.sum(F.when(y > 0, ra)) / F.count(F.when(y > 0, 1))).alias("nonzero_mae"))


def notebook_risk_groups(long: DataFrame, group_cols: Sequence[str] = ("model",), actual: str = "actual",
                         predicted: str = "predicted") -> DataFrame:
    """M8: Low = no claim; with more than 10 positives, High = above the
    median of positive actuals and Medium otherwise; else binary Low/High."""
    g = list(group_cols)
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    med = exact_quantiles(long.where(y > 0), actual, [0.5], group_cols=g).select(*g, F.col("quantile").alias("_med"))
    npos = long.groupBy(*g).agg(F.count(F.when(y > 0, 1)).alias("_npos"))
    # broadcast bound: one row per model
    sc = F.broadcast(npos.join(med, g, "left"))
    j = long.join(sc, g)
    grp = (F.when(y == 0, "Low Risk")
            .when(F.col("_npos") > 10, F.when(y > F.col("_med"), "High Risk").otherwise("Medium Risk"))
            .otherwise("High Risk"))
    return j.groupBy(*g, grp.alias("risk_group")).agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        F.count(F.lit(1)).cast("bigint").alias("n"))


def key_comparison(metrics: DataFrame, models: Sequence[str], metrics_list: Sequence[str] = KEY_METRICS) -> DataFrame:
    """Metrics as rows, models as columns."""
    long = metrics.select("model", *metrics_list).unpivot(["model"], list(metrics_list), "metric", "value")
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def best_model(metrics: DataFrame, by: str = "f1") -> DataFrame:
    """Highest ``by``; ties go to the earlier model in MODEL_ORDER."""
    order = F.coalesce(F.element_at(F.create_map(*[x for k, v in MODEL_ORDER.items() for x in (F.lit(k), F.lit(v))]),
                                    F.col("model")), F.lit(99))
    return metrics.orderBy(F.desc(by), order, "model").limit(1)


def error_frame(sc_wide: DataFrame, context: DataFrame | None, models: Sequence[str],
                key: str = "IDpol", context_cols: Sequence[str] = ()) -> DataFrame:
    """Actual, predictions, signed (predicted - actual) and absolute
    errors per model, joined to policy context on the key (not by position)."""
    cols = {}
    for m in models:
        e = F.col(f"predicted_{m}") - F.col("actual")
        cols[f"error_{m}"] = e
        cols[f"abs_error_{m}"] = F.abs(e)
    out = sc_wide.withColumns(cols)
    if context is not None:
        out = out.join(context.select(key, *context_cols), key, "left")
    return out


def top_errors(long: DataFrame, n: int = 10, group_cols: Sequence[str] = ("model",), key: str = "IDpol",
               models: Sequence[str] | None = None, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """H2: the n largest absolute errors per model (ties by key). One
    TakeOrdered per model (each partition keeps its own top n), no window."""
    e = (F.col(predicted) - F.col(actual)).alias("error")
    base = long.select(*group_cols, key, actual, predicted, e).withColumn("abs_error", F.abs(F.col("error")))
    if models is None:
        raise ValueError("pass the model names")
    out = None
    for m in models:
        t = base.where(F.col(group_cols[0]) == m).orderBy(F.desc("abs_error"), key).limit(n)
        out = t if out is None else out.unionByName(t)
    return out


def best_model_errors(long: DataFrame, model: str, features: DataFrame, n: int = 10, key: str = "IDpol") -> DataFrame:
    """H6: the model's n largest absolute errors (ties by key) with all columns of ``features``."""
    e = long.where(F.col("model") == model).select("model", key, "actual", "predicted", F.abs(F.col("actual") - F.col("predicted")).alias("error"))
    # broadcast bound: n rows
    return features.join(F.broadcast(e.orderBy(F.desc("error"), key).limit(n)), key).select(
        "model", key, "actual", "predicted", "error", *[c for c in features.columns if c != key])
