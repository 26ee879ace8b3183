"""Portfolio profiles: shape, null/inf counts, value counts, shares,
describe(), distinct counts, segment summaries, correlations, class means.

Each profile is one aggregate job (several statistics fused into a single
``agg``), reshaped with ``unpivot``/``explode`` instead of per-column scans.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null
from ..session import materialize, parallelism
from .ordering import exact_quantiles
from .selection import is_scan


def _ratio(a, b):
    """a / b, null when b is zero (ANSI mode raises on division by zero)."""
    return F.when(b != 0, a / b)


def shape(df: DataFrame) -> DataFrame:
    """A2: (n_rows, n_columns)."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")) \
             .withColumn("n_columns", F.lit(len(df.columns)).cast("int"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A3: (column_name, n_null) in one pass."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "n_null")


def inf_profile(df: DataFrame) -> DataFrame:
    """A4: (column_name, n_inf) over the floating columns, one pass."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    wide = df.agg(*[F.count(F.when(F.abs(F.col(c)) == F.lit(float("inf")), 1)).cast("bigint").alias(c)
                    for c in cols])
    return wide.unpivot([], cols, "column_name", "n_inf")


def preview(df: DataFrame, n: int = 5, key: str = "IDpol") -> DataFrame:
    """A5: deterministic head (TakeOrdered, no global sort)."""
    return df.orderBy(key).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """counts by value, sorted by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(col)


def claim_shares(df: DataFrame, target: str = "ClaimNb", exposure: str = "Exposure",
                 short: float = 0.05) -> DataFrame:
    """F2 + F3: percent of zero / one / many claims and very short exposures."""
    y = F.col(target)
    pct = lambda cond: (F.avg(cond.cast("double")) * 100).alias
    return df.agg(pct(y == 0)("pct_zero"), pct(y == 1)("pct_one"), pct(y > 1)("pct_many"),
                  pct(F.col(exposure) < short)("pct_very_short"))


def describe(df: DataFrame, cols: Sequence[str], max_buffered_distinct: int = 200_000) -> DataFrame:
    """pandas describe(): count, mean, sample std, min, quartiles, max.

    One aggregate for the moments and HyperLogLog distinct estimates, one for
    the exact quartiles of every column whose estimate allows the buffered
    ``percentile``; other columns take the distributed exact path."""
    cols = list(cols)
    spark = df.sparkSession
    # one rule for both paths: NaN and null are skipped
    df = df.select(*[nan_to_null(c).alias(c) for c in cols])
    if not is_scan(df):            # read once per step below
        df = materialize(df, "describe", min_partitions=parallelism(spark))
    stats = df.agg(*[F.struct(F.count(c).cast("bigint").alias("count"), F.avg(c).alias("mean"),
                              F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                              F.max(c).cast("double").alias("max"),
                              F.approx_count_distinct(c).alias("_d")).alias(c) for c in cols]).first()
    probs = [0.25, 0.5, 0.75]
    small = [c for c in cols if stats[c]["_d"] <= max_buffered_distinct]
    q = {}
    if small:
        arr = F.array(*[F.lit(x) for x in probs])
        row = df.agg(*[F.percentile(F.col(c).cast("double"), arr).alias(c) for c in small]).first()
        q.update({c: list(row[c]) if row[c] is not None else [None] * 3 for c in small})
    for c in cols:
        if c not in q:
            got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, c, probs, method="distributed").collect()}
            q[c] = [got.get(x) for x in probs]
    rows = [(c, stats[c]["count"], stats[c]["mean"], stats[c]["std"], stats[c]["min"], *q[c], stats[c]["max"])
            for c in cols]
    return spark.createDataFrame(rows, "variable string, count bigint, mean double, std double, min double, "
                                       "p25 double, p50 double, p75 double, max double")


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """(column_name, n_distinct)."""
    fn = F.approx_count_distinct if approx else F.countDistinct
    wide = df.agg(*[fn(c).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column_name", "n_distinct")


def segment_share(df: DataFrame, col: str) -> DataFrame:
    """normalised value counts (%). The total is a one-row aggregate."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    total = counts.agg(F.sum("n")).scalar()          # scalar subquery, evaluated once
    return counts.select(col, "n", (F.col("n") * 100.0 / total).alias("pct"))


def segment_summary(df: DataFrame, col: str, target: str = "ClaimNb", exposure: str = "Exposure") -> DataFrame:
    """Minimum slice: per segment policies, claims, exposure, frequency, share."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("policies"),
                            F.sum(target).cast("bigint").alias("claims"),
                            F.sum(exposure).alias("exposure"))
    tot = g.agg(F.sum("policies")).scalar()          # scalar subquery, evaluated once
    return g.select(col, "policies", "claims", "exposure", _ratio(F.col("claims"), F.col("exposure")).alias("frequency"),
                    (F.col("policies") * 100.0 / tot).alias("share_pct"))


def mean_by(df: DataFrame, col: str, target: str = "ClaimNb") -> DataFrame:
    """(segment, mean, count, mean_pct) for observed segments."""
    return df.groupBy(col).agg(F.avg(target).alias("mean_claims"), F.count(F.lit(1)).cast("bigint").alias("count")) \
             .withColumn("mean_pct", F.col("mean_claims") * 100)


def mean_by_categories(df: DataFrame, cols: Sequence[str], target: str = "ClaimNb") -> DataFrame:
    """F8: mean target per value of several categories, one shuffle:
    (variable, value, mean_claims) via unpivot before the groupBy, sorted by
    mean descending within each variable."""
    long = df.select(F.col(target), *[F.col(c).cast("string").alias(c) for c in cols]) \
             .unpivot([target], list(cols), "variable", "value")
    return long.groupBy("variable", "value").agg(F.avg(target).alias("mean_claims")) \
               .orderBy("variable", F.desc("mean_claims"), "value")


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, value, count) ordered by count desc within variable."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).cast("bigint").alias("count")) \
               .orderBy("variable", F.desc("count"), "value")


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation, lower triangle without diagonal (pair (x, y)
    with y before x in ``cols``).

    Two passes instead of one ``corr`` per pair: means and null counts, then
    centred cross-product sums S_xy (numerically stable, a single plain
    ``sum`` buffer per pair, so whole-stage codegen survives hundreds of
    pairs); r = S_xy / sqrt(S_xx S_yy). With nulls every pair counts the rows
    where both are there: block-wise products of the centred columns and of
    their masks give all pairs' sums in one job (``_masked_products``). NaN counts
    as null; a pair with an infinite value has no correlation."""
    cols = list(cols)
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i)]
    x = {c: nan_to_null(c) for c in cols}
    first = df.agg(*[F.avg(x[c]).alias(f"m\u0001{c}") for c in cols],
                   *[F.count(F.when(x[c].isNull(), 1)).alias(f"n\u0001{c}") for c in cols]).first()
    spark = df.sparkSession
    if all(first[f"n\u0001{c}"] == 0 for c in cols):
        d = {c: x[c] - F.lit(first[f"m\u0001{c}"]) for c in cols}
        sums = df.agg(*[F.sum(d[c] * d[c]).alias(f"s\u0001{c}\u0001{c}") for c in cols],
                      *[F.sum(d[a] * d[b]).alias(f"s\u0001{a}\u0001{b}") for a, b in pairs]).first()
        rows = []
        for a, b in pairs:
            den = (sums[f"s\u0001{a}\u0001{a}"] * sums[f"s\u0001{b}\u0001{b}"]) ** 0.5
            rows.append((a, b, sums[f"s\u0001{a}\u0001{b}"] / den if den else None))
        return spark.createDataFrame(rows, "var_x string, var_y string, corr double")
    means = [first[f"m\u0001{c}"] for c in cols]
    means = [v if v is not None and abs(v) < float("inf") else 0.0 for v in means]      # any shift gives the same result
    values = F.array(*[F.coalesce(x[c], F.lit(float("nan"))) for c in cols])
    cells = df.select(values.alias("x")).mapInArrow(_masked_products(means), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((5, len(cols), len(cols)))       # bounded by the columns, not the rows
    for r in cells:
        sums.reshape(-1)[r["cell"]] = r["v"]
    dd, dm, qm, mm, im = sums
    out = []
    for i in range(len(cols)):
        for j in range(i):
            n, value = mm[i, j], None
            if n and not im[i, j] and not im[j, i]:
                den = (qm[i, j] - dm[i, j] ** 2 / n) * (qm[j, i] - dm[j, i] ** 2 / n)
                value = float((dd[i, j] - dm[i, j] * dm[j, i] / n) / den ** 0.5) if den > 0 else None
            out.append((cols[i], cols[j], value))
    return spark.createDataFrame(out, "var_x string, var_y string, corr double")


def _masked_products(means: list):
    """Rows (cell, v): entries of the five matrices of sums over the rows where both columns of a
    pair are there: products, values, squares, rows, infinite values."""
    width = len(means)

    def run(batches):
        total = np.zeros((5, width, width))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, width)
            there, endless = (~np.isnan(x)).astype(float), np.isinf(x)
            d = np.where(np.isfinite(x), x - np.array(means), 0.0)
            total += [d.T @ d, d.T @ there, (d * d).T @ there, there.T @ there, endless.T.astype(float) @ there]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.reshape(-1))], names=["cell", "v"])
    return run


def claim_class(target: str = "ClaimNb"):
    y = F.col(target)
    return F.when(y == 0, "none").when(y == 1, "one").when(y > 1, "many")


def class_means(df: DataFrame, cols: Sequence[str], target: str = "ClaimNb") -> DataFrame:
    """mean of each variable per claim class and ratio to the no-claim mean."""
    g = df.groupBy(claim_class(target).alias("claim_class")).agg(*[F.avg(c).alias(c) for c in cols])
    long = g.unpivot(["claim_class"], list(cols), "variable", "mean")
    base = long.where(F.col("claim_class") == "none").select("variable", F.col("mean").alias("_base"))
    # broadcast bound: one row per variable
    return long.join(F.broadcast(base), "variable", "left").select(
        "claim_class", "variable", "mean", _ratio(F.col("mean"), F.col("_base")).alias("ratio_to_none"))


def imbalance(df: DataFrame, target: str = "ClaimNb") -> DataFrame:
    """zeros / positives, 1 when there are no positives."""
    y = F.col(target)
    a = df.agg(F.count(F.when(y == 0, 1)).cast("bigint").alias("n_zero"),
               F.count(F.when(y > 0, 1)).cast("bigint").alias("n_positive"))
    return a.withColumn("scale_pos_weight", F.when(F.col("n_positive") == 0, F.lit(1.0))
                        .otherwise(F.col("n_zero") / F.col("n_positive")))


def relativities(df: DataFrame, segments: dict, target: str = "ClaimNb", exposure: str = "Exposure") -> DataFrame:
    """claim frequency inside / outside each segment and their ratio, all
    segments as conditional sums in one aggregate."""
    aggs = []
    for name, cond in segments.items():
        inside = F.coalesce(cond, F.lit(False))
        aggs.append(F.struct(
            F.count(F.when(inside, 1)).cast("bigint").alias("policies"),
            _ratio(F.sum(F.when(inside, F.col(target)).otherwise(0)),
                   F.sum(F.when(inside, F.col(exposure)).otherwise(0.0))).alias("freq_in"),
            _ratio(F.sum(F.when(~inside, F.col(target)).otherwise(0)),
                   F.sum(F.when(~inside, F.col(exposure)).otherwise(0.0))).alias("freq_out")).alias(name))
    rows = df.agg(*aggs).unpivot([], list(segments), "segment", "s").select("segment", "s.*")
    return rows.withColumn("relativity", _ratio(F.col("freq_in"), F.col("freq_out")))
