"""Column-expression helpers (all JVM-side, codegen-friendly; no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """bool -> 0/1 int; a null comparison counts as 0 (pandas compares NaN as False)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def finite_or_null(c) -> Column:
    """NaN and +/-Inf become NULL (pandas has one missing value)."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None).cast("double")).otherwise(c)


def nan_to_null(c) -> Column:
    """NaN becomes NULL, infinities stay: the one rule for what statistics and
    percentiles skip (as pandas does), on every path."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def is_finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def nan_to_num(c, nan=0.0, posinf=1e10, neginf=-1e10) -> Column:
    """NaN -> nan, +Inf -> posinf, -Inf -> neginf."""
    c = col(c)
    return (F.when(F.isnan(c), F.lit(nan))
             .when(c == F.lit(INF), F.lit(posinf))
             .when(c == F.lit(-INF), F.lit(neginf))
             .otherwise(c))


def clip(c, lower=None, upper=None) -> Column:
    """Null-preserving clip."""
    c = col(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNull(), None).otherwise(out)


def poisson_deviance_term(y, p, variant: str = "module") -> Column:
    """Per-row Poisson deviance.

    module:   y_t, y_p floored at 1e-10, log term 0 where y_t <= 1e-10,
              nan/inf mapped (inf -> 1e10), clipped to [-1e6, 1e6].
    notebook: same floors, log term always evaluated, +/-inf -> 1e10,
              upper clip 1e6 only.
    """
    eps = F.lit(1e-10)
    yt = F.greatest(col(y).cast("double"), eps)
    yp = F.greatest(col(p).cast("double"), eps)
    if variant == "module":
        log_term = F.when(yt > eps, yt * F.log(yt / yp)).otherwise(F.lit(0.0))
        dev = F.lit(2.0) * (log_term - (yt - yp))
        return clip(nan_to_num(dev, 0.0, 1e10, -1e10), -1e6, 1e6)
    if variant == "notebook":
        dev = F.lit(2.0) * (yt * F.log(yt / yp) - (yt - yp))
        return clip(nan_to_num(dev, 0.0, 1e10, 1e10), None, 1e6)
    raise ValueError(f"unknown deviance variant {variant!r}")


def qcut_bin(rank: Column, n: Column, q: int) -> Column:
    """Pandas qcut of a 1..n 'first' rank into q equal-count bins.

    Edges are the linear-interpolated quantiles of 1..n, i.e. 1 + (n-1)k/q;
    rank r lands in the first bin whose right edge is >= r.
    """
    return F.when(n <= 1, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.ceil((rank - F.lit(1)) * F.lit(float(q)) / (n - F.lit(1))) - F.lit(1))
    ).cast("int")


def position_bin(pos0: Column, n: Column, q: int) -> Column:
    """Np.linspace edges over positions 0..n-1, left-closed bins."""
    return F.least(F.floor(pos0 * F.lit(float(q)) / n), F.lit(q - 1)).cast("int")


def safe_div(a, b, default=0.0) -> Column:
    a, b = col(a), col(b)
    return F.when((b.isNull()) | (b == 0), F.lit(default)).otherwise(a / b)
