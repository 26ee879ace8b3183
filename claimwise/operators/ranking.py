"""Rank-based evaluation: lift tables (G1-G4), precision-recall curve,
average precision and best-F1 threshold (G5-G8).

Inputs are long-form scores ``(group..., IDpol, actual, predicted)``; every
operator runs for all groups (models) in the same jobs. No window spans a
whole model: ranks come from ``global_row_number`` and running sums from
``prefix_sums`` (range-partitioned), and the PR curve is first reduced to one
row per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_finite, position_bin, qcut_bin
from ..session import materialize
from . import selection
from .ordering import global_row_number, prefix_sums


def finite_pairs(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Rows where both values are finite."""
    return df.where(is_finite(F.col(actual).cast("double")) & is_finite(F.col(predicted).cast("double")))


def finite_pair_counts(df: DataFrame, group_cols: Sequence[str] = ("model",),
                       actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """C3 with the removed count, one pass."""
    ok = is_finite(F.col(actual).cast("double")) & is_finite(F.col(predicted).cast("double"))
    return df.groupBy(*group_cols).agg(F.count(F.when(ok, 1)).cast("bigint").alias("n_valid"),
                                       F.count(F.when(~ok, 1)).cast("bigint").alias("n_removed"))


def ranked(df: DataFrame, group_cols: Sequence[str] = ("model",), key: str = "IDpol",
           predicted: str = "predicted") -> DataFrame:
    """G1: rank 1..n within each group by (predicted, key) — 'first' ranks
    with ties broken by key — plus the group size n."""
    g = list(group_cols)
    r = global_row_number(df, [*g, predicted, key], out="_grn")
    start = r.groupBy(*g).agg(F.min("_grn").alias("_start"), F.count(F.lit(1)).alias("n"))
    # broadcast bound: one row per group (model)
    return r.join(F.broadcast(start), g).select(*df.columns, (F.col("_grn") - F.col("_start") + 1).alias("rank"), "n")


def _last_ranks(n: int, n_bins: int, method: str) -> list[int]:
    """1-based last rank of every bin but the last: ranks up to the b-th belong to bins 0..b."""
    if method == "qcut":
        return [min(n, 1 + (b + 1) * (n - 1) // n_bins) for b in range(n_bins - 1)]
    if method == "position":
        return [min(n, -(-(b + 1) * n // n_bins)) for b in range(n_bins - 1)]
    raise ValueError(method)


def _bins_by_boundaries(valid: DataFrame, g: list[str], key: str, predicted: str, n_bins: int, method: str):
    """The bin of each row as an expression over the boundary scores of its group, and
    over the boundary keys where rows with one score fall into several bins; None beyond
    the limits of ``selection``."""
    p = F.col(predicted).cast("double")
    rows = selection.sketches(valid, p, g)
    if rows is None:
        return None
    rows = [r for r in rows if r["_n"]]
    group = selection.group_index(g, [tuple(r[c] for c in g) for r in rows])
    last = [_last_ranks(r["_n"], n_bins, method) for r in rows]
    cells = selection.counts(valid, p, group, [selection.merged([selection.bracket(r["_n"], r["_grid"], k - 1) for k in ks]) for r, ks in zip(rows, last)])
    if cells is None:
        return None
    cuts, tied = [], [{} for _ in rows]       # per group: (score, rows with it that belong below); those in several bins
    for k, ks in enumerate(last):
        cuts.append([])
        for r in ks:
            found = selection.at_rank(cells[k], r - 1)
            if found is None:
                return None
            score, below, same = found
            cuts[k].append((score, r - below))
            if r - below < same:
                tied[k].setdefault(score, set()).add(r - below)
    keys = _boundary_keys(valid, group, p, key, tied) if any(tied) else {}
    if keys is None:
        return None
    scores = selection.constant([[s for s, _ in c] for c in cuts], "array<array<double>>")
    above = F.size(F.filter(scores[group], lambda x: p > x))
    if keys:
        # a boundary score in several bins: rows behind the boundary's key are above it
        within = selection.constant([[{"s": s, "k": keys[k, s, r]} for s, r in c if (k, s, r) in keys] for k, c in enumerate(cuts)], "array<array<struct<s:double,k:bigint>>>")
        above = above + F.size(F.filter(within[group], lambda x: (x["s"] == p) & (F.col(key) > x["k"])))
    return F.coalesce(above, F.lit(0))


def _boundary_keys(valid: DataFrame, group, p, key: str, tied: list[dict]) -> dict | None:
    """{(group, score, rows below): key of the last of these rows}, by selection on the keys of
    the rows with such a score; None beyond the limits of ``selection``."""
    scores = [sorted(t) for t in tied]
    places = [(k, s) for k, ss in enumerate(scores) for s in ss]
    if len(places) > selection.MAX_GROUPS or valid.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return None
    starts = [sum(map(len, scores[:k])) for k in range(len(scores))]
    at = F.array_position(selection.constant(scores, "array<array<double>>")[group], p)
    inside = valid.select(F.col(key).cast("long").alias("_k"), (selection.constant(starts, "array<int>")[group] + at.cast("int") - 1).alias("_t"), at.alias("_a")).where("_a > 0")
    rows = {r["_t"]: r for r in selection.sketches(inside, F.col("_k"), ["_t"])}
    brackets = [selection.merged([selection.bracket(rows[t]["_n"], rows[t]["_grid"], r - 1) for r in tied[k][s]]) for t, (k, s) in enumerate(places)]
    cells = selection.counts(inside, F.col("_k"), F.col("_t"), brackets, "bigint")
    if cells is None:
        return None
    out = {}
    for t, (k, s) in enumerate(places):
        for r in tied[k][s]:
            found = selection.at_rank(cells[t], r - 1)
            if found is None or found[1] + found[2] != r:      # a key that is there twice
                return None
            out[k, s, r] = found[0]
    return out


def lift_table(df: DataFrame, n_bins: int = 10, group_cols: Sequence[str] = ("model",), method: str = "qcut",
               key: str = "IDpol", actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(group..., bin, avg_actual, avg_predicted, count, lift); bin 0 = lowest scores.

    method="qcut":     pandas qcut of the 'first' rank (equal-count bins).
    method="position": the positional fallback (linspace edges over 0..n-1).

    Bins follow from the scores at their boundary ranks, found by selection; rows with a
    boundary score in several bins are told apart by the key at the boundary, found the same
    way. No row is ranked or sorted. Beyond the limits of ``selection`` rows are ranked."""
    g = list(group_cols)
    if method not in ("qcut", "position"):
        raise ValueError(method)
    valid = finite_pairs(df, actual, predicted).select(*g, key, actual, predicted)
    if not selection.is_scan(valid):
        valid = materialize(valid, "lift")          # read by three scans
    b = _bins_by_boundaries(valid, g, key, predicted, n_bins, method)
    if b is None:
        valid = ranked(valid, g, key, predicted)
        b = qcut_bin(F.col("rank"), F.col("n"), n_bins) if method == "qcut" else position_bin(F.col("rank") - 1, F.col("n"), n_bins)
    per_bin = valid.groupBy(*g, b.alias("bin")).agg(F.sum(actual).alias("_a"), F.sum(predicted).alias("_p"), F.count(F.lit(1)).cast("bigint").alias("count"))
    # one row per bin: the window holds a group's bins
    w = Window.partitionBy(*g)
    overall = F.sum("_a").over(w) / F.sum("count").over(w)
    out = per_bin.select(*g, "bin", (F.col("_a") / F.col("count")).alias("avg_actual"), (F.col("_p") / F.col("count")).alias("avg_predicted"), "count",
                         overall.alias("_overall"))
    return out.select(*g, "bin", "avg_actual", "avg_predicted", "count",
                      (F.col("avg_actual") / F.when(F.col("_overall") == 0, F.lit(1e-10)).otherwise(F.col("_overall"))).alias("lift"))


def _two_class_groups(per_score: DataFrame, g: list[str]) -> DataFrame:
    """F21 guard: groups with both classes present (one row per group), from the
    positives ``p`` and rows ``k`` per distinct score."""
    return per_score.groupBy(*g).agg(F.sum("p").alias("total_pos"), F.sum("k").alias("_n")) \
                    .where((F.col("total_pos") > 0) & (F.col("total_pos") < F.col("_n"))).drop("_n")


def pr_curve(df: DataFrame, group_cols: Sequence[str] = ("model",), actual: str = "actual",
             predicted: str = "predicted", final_point: bool = True) -> DataFrame:
    """G5 + G7: one point per distinct score (a claim is predicted when
    score >= threshold) with precision, recall, f1; plus the final point
    (threshold null, precision 1, recall 0). Groups with one class are skipped."""
    g = list(group_cols)
    valid = finite_pairs(df, actual, predicted)
    per_score = valid.select(*g, F.col(predicted).cast("double").alias("threshold"), (F.col(actual) > 0).cast("long").alias("p"), F.lit(1).cast("long").alias("k"))
    cum = prefix_sums(per_score, [F.col("threshold").desc()], ["p", "k"], group_cols=g, by_key=True)
    totals = _two_class_groups(cum, g)
    # broadcast bound: one row per group
    pts = cum.join(F.broadcast(totals), g).select(
        *g, "threshold", "p",
        (F.col("cum_p") / F.col("cum_k")).alias("precision"),
        (F.col("cum_p") / F.col("total_pos")).alias("recall"),
        (F.col("p") / F.col("total_pos")).alias("_drecall"))
    pts = pts.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    if not final_point:
        return pts
    last = totals.select(*g, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("p"),
                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                         F.lit(0.0).alias("_drecall"), F.lit(0.0).alias("f1"))
    return pts.unionByName(last)


def pr_summary(df: DataFrame, group_cols: Sequence[str] = ("model",), actual: str = "actual",
               predicted: str = "predicted") -> DataFrame:
    """G6 + G8: average precision (step-wise sum of recall increments times
    precision) and the best-F1 point (first maximum in ascending-threshold
    order), all from one aggregate over the curve."""
    g = list(group_cols)
    pts = pr_curve(df, g, actual, predicted, final_point=False)
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg_t"), F.col("precision"), F.col("recall")))
    a = pts.groupBy(*g).agg(F.sum(F.col("_drecall") * F.col("precision")).alias("average_precision"),
                            best.alias("_b"), F.count(F.lit(1)).cast("bigint").alias("n_points"))
    return a.select(*g, "average_precision", (-F.col("_b.neg_t")).alias("best_threshold"),
                    F.col("_b.precision").alias("best_precision"), F.col("_b.recall").alias("best_recall"),
                    F.col("_b.f1").alias("best_f1"), "n_points")
