"""Distribution tables behind the reference's charts (the charts themselves
are not drawn): equal-width histograms (F14, F19), binned Gaussian KDE (F15),
box statistics (F16, F17), 2-D density of actual vs predicted (F22), ranges
(F20) and class guards (F21).

All variables are processed together in long form (``unpivot``), so each
table costs one or two aggregate jobs whatever the number of variables, and
output size is bounded by bins x variables, not by rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import exact_quantiles


def to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), name: str = "variable",
            value: str = "value") -> DataFrame:
    """Wide -> long (melt)."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(ids), list(cols), name, value)


def histogram(long: DataFrame, bins: int = 30, group_cols: Sequence[str] = ("variable",),
              value: str = "value") -> DataFrame:
    """(group..., bin, lo, hi, count): equal-width bins over [min, max] of each
    group, last bin right-closed, empty bins kept (bins generated per group
    from the one-row-per-group range table, no cross join)."""
    g = list(group_cols)
    v = F.col(value)
    data = long.where(v.isNotNull() & ~F.isnan(v))
    rng = data.groupBy(*g).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # broadcast bound: one row per variable
    j = data.join(F.broadcast(rng), g)
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((v - F.col("_lo")) * F.lit(float(bins)) / width), F.lit(bins - 1))).cast("int")
    counts = j.groupBy(*g, b.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    frame = rng.select(*g, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / F.lit(float(bins))
    return frame.join(counts, [*g, "bin"], "left").select(
        *g, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def kde(long: DataFrame, grid: int = 200, fine_bins: int = 512, group_cols: Sequence[str] = ("variable",),
        value: str = "value") -> DataFrame:
    """Gaussian KDE on a grid of ``grid`` points over [min, max], Scott
    bandwidth h = sd * n^(-1/5). Values are first counted into ``fine_bins``
    equal-width bins (binned KDE), so the kernel sum costs bins x grid per
    variable, independent of row count."""
    g = list(group_cols)
    v = F.col(value)
    data = long.where(v.isNotNull() & ~F.isnan(v))
    st = data.groupBy(*g).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                              F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_sd"))
    st = st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    # broadcast bound: one row per variable
    j = data.join(F.broadcast(st), g)
    width = F.col("_hi") - F.col("_lo")
    fb = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((v - F.col("_lo")) * F.lit(float(fine_bins)) / width), F.lit(fine_bins - 1)))
    binned = j.groupBy(*g, fb.cast("int").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    pts = binned.join(F.broadcast(st), g) \
        .withColumn("_x", F.col("_lo") + (F.col("_b") + 0.5) * (F.col("_hi") - F.col("_lo")) / F.lit(float(fine_bins))) \
        .withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    gx = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("grid_index") / F.lit(float(grid - 1))
    z = (gx - F.col("_x")) / F.col("_h")
    contrib = F.col("_c") * F.exp(-0.5 * z * z)
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    # a constant variable has no spread (h = 0) and gets no density rows
    pts = pts.where(F.col("_h") > 0)
    return pts.groupBy(*g, "grid_index").agg(F.first(gx).alias("x"), (F.sum(contrib) / F.first(norm)).alias("density"))


def kde_linear(long: DataFrame, grid: int = 200, per_bandwidth: int = 16, max_nodes: int = 65_536, step: float | None = None,
               group_cols: Sequence[str] = ("variable",), value: str = "value") -> DataFrame:
    """F15 with a stated error: (group..., grid_index, x, density, error_bound).

    A value's weight goes to the two nodes around it in proportion to its place (linear
    binning), so the kernel is interpolated between nodes and the density differs from the sum
    over all values by at most step^2 / (8 h^3 sqrt(2 pi)), the ``error_bound``. There are
    ``per_bandwidth`` nodes to a bandwidth, up to ``max_nodes`` in all; with a given ``step`` of which
    all values are multiples away from the smallest, nothing is interpolated. Infinite values are left out."""
    g = list(group_cols)
    v = F.col(value).cast("double")
    data = long.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*g, v.alias("_x"))
    st = data.groupBy(*g).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"))
    st = st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).where("_h > 0")   # no spread, no density
    width = F.col("_hi") - F.col("_lo")
    nodes = F.least(F.lit(float(max_nodes - 1)), F.ceil(width * per_bandwidth / F.col("_h")))
    st = st.withColumn("_d", F.lit(float(step)) if step else width / nodes)
    # broadcast bound: one row per group
    at = data.join(F.broadcast(st), g).select(*g, ((F.col("_x") - F.col("_lo")) / F.col("_d")).alias("_p"))
    at = at.select(*g, F.floor("_p").alias("_i"), (F.col("_p") - F.floor("_p")).alias("_w"))
    # map-side: one row per node and task
    halves = at.groupBy(*g, "_i").agg(F.sum(1 - F.col("_w")).alias("_a"), F.sum("_w").alias("_b"))
    both = F.array(F.struct(F.col("_i").alias("node"), F.col("_a").alias("c")), F.struct((F.col("_i") + 1).alias("node"), F.col("_b").alias("c")))
    weights = halves.select(*g, F.explode(both).alias("_s")).groupBy(*g, F.col("_s.node").alias("_node")).agg(F.sum("_s.c").alias("_c")).where("_c > 0")
    pts = weights.join(F.broadcast(st), g).withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    gx = F.col("_lo") + width * F.col("grid_index") / F.lit(float(grid - 1))
    z = (gx - (F.col("_lo") + F.col("_node") * F.col("_d"))) / F.col("_h")
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    bound = F.col("_d") * F.col("_d") / (8 * F.pow("_h", F.lit(3.0)) * math.sqrt(2 * math.pi))
    return pts.groupBy(*g, "grid_index").agg(F.first(gx).alias("x"), (F.sum(F.col("_c") * F.exp(-0.5 * z * z)) / F.first(norm)).alias("density"),
                                             F.first(F.lit(0.0) if step else bound).alias("error_bound"))


def box_stats(long: DataFrame, group_cols: Sequence[str], value: str = "value", whisker: float = 1.5) -> DataFrame:
    """Quartiles (exact), IQR, whisker ends (most extreme values
    within 1.5 IQR of the box) and outlier counts per group. Two passes: the
    quartiles, then one aggregate with the quartiles broadcast."""
    g = list(group_cols)
    v = F.col(value)
    data = long.where(v.isNotNull() & ~F.isnan(v))
    q = exact_quantiles(data, value, [0.25, 0.5, 0.75], group_cols=g)
    qw = q.groupBy(*g).pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("quantile")).toDF(*g, "q1", "median", "q3")
    qw = qw.withColumn("iqr", F.col("q3") - F.col("q1")) \
           .withColumn("_lo", F.col("q1") - whisker * F.col("iqr")).withColumn("_hi", F.col("q3") + whisker * F.col("iqr"))
    # broadcast bound: one row per group (variables x classes)
    j = data.join(F.broadcast(qw), g)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    a = j.groupBy(*g).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                          F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
                          F.count(F.when(~inside, 1)).cast("bigint").alias("n_outliers"))
    return qw.join(a, g).select(*g, "n", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "n_outliers")


def ranges(long: DataFrame, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """min/max of actual and predicted per model."""
    return long.groupBy(*group_cols).agg(F.min("actual").cast("double").alias("min_actual"),
                                         F.max("actual").cast("double").alias("max_actual"),
                                         F.min("predicted").alias("min_predicted"),
                                         F.max("predicted").alias("max_predicted"))


def positive_rate(long: DataFrame, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """positive rate and number of classes present (PR-curve guard)."""
    y = F.col("actual") > 0
    return long.groupBy(*group_cols).agg(F.avg(y.cast("double")).alias("positive_rate"),
                                         F.countDistinct(y).cast("bigint").alias("n_classes"))


def scatter_density(long: DataFrame, bins: int = 50, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """counts of (actual value, predicted bin) - a bounded stand-in for
    an alpha scatter plot."""
    g = list(group_cols)
    long = long.where(F.col("predicted").isNotNull() & ~F.isnan("predicted"))   # before the range: NaN sorts last
    rng = long.groupBy(*g).agg(F.min("predicted").alias("_lo"), F.max("predicted").alias("_hi"))
    # broadcast bound: one row per model
    j = long.join(F.broadcast(rng), g)
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("predicted") - F.col("_lo")) * F.lit(float(bins)) / width), F.lit(bins - 1))).cast("int")
    return j.groupBy(*g, F.col("actual").alias("actual"), b.alias("predicted_bin")) \
            .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
