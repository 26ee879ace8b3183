"""Exposure handling for frequency models (K1-K6) and the train/test split
(J1) and folds (J2).

``TargetPrep.fit`` computes the one fitted scalar (the p99 cap of positive
claim frequencies) on the training rows; ``transform`` adds
``exposure_adj``, ``offset``, ``frequency`` and ``target`` as column
expressions, so scoring data never needs another pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import exact_quantiles

# Fixed values from the reference.
MIN_EXPOSURE = 0.05
FREQ_CAP_PERCENTILE = 0.99
TARGET_FLOOR = 1e-6
MAX_PRED_RATE = 1.0


@dataclass
class TargetPrep:
    """mode="reference": capped, floored rate as label plus log-exposure offset
    (what the reference fits; exposure counted twice).
    mode="actuarial": claim count as label with the offset (rate * exposure)."""
    cap: float | None
    exposure_col: str | None = "Exposure"
    target_col: str = "ClaimNb"
    mode: str = "reference"
    floor: float | None = TARGET_FLOOR

    @classmethod
    def fit(cls, train: DataFrame, exposure_col: str | None = "Exposure", target_col: str = "ClaimNb",
            mode: str = "reference", floor: float | None = TARGET_FLOOR) -> "TargetPrep":
        if exposure_col is None or exposure_col not in train.columns:
            return cls(None, None, target_col, mode, floor)          # K6
        freq = F.col(target_col) / F.greatest(F.col(exposure_col), F.lit(MIN_EXPOSURE))
        pos = train.select(freq.alias("_f")).where(F.col("_f") > 0)
        q = exact_quantiles(pos, "_f", [FREQ_CAP_PERCENTILE]).first()
        return cls(q["quantile"] if q else None, exposure_col, target_col, mode, floor)

    def transform(self, df: DataFrame) -> DataFrame:
        y = F.col(self.target_col).cast("double")
        if self.exposure_col is None:
            return df.withColumns({"exposure_adj": F.lit(1.0), "offset": F.lit(0.0), "frequency": y, "target": y})
        adj = F.greatest(F.col(self.exposure_col).cast("double"), F.lit(MIN_EXPOSURE))       # K1
        out = df.withColumns({"exposure_adj": adj, "offset": F.log(adj), "frequency": y / adj})  # K2, K3
        if self.mode == "actuarial":
            return out.withColumn("target", y)
        t = F.col("frequency")
        if self.cap is not None:
            t = F.least(t, F.lit(self.cap))                                                   # K4
        if self.floor is not None:
            t = F.greatest(t, F.lit(self.floor))                                              # K5
        return out.withColumn("target", t)


def to_counts(rate, exposure_adj, nonnegative: bool = False):
    """L4: min(rate, 1) x exposure_adj (then max(., 0) for Tweedie)."""
    out = F.least(rate, F.lit(MAX_PRED_RATE)) * exposure_adj
    return F.greatest(out, F.lit(0.0)) if nonnegative else out


def key_bucket(key: str = "IDpol", seed: int = 42, buckets: int = 10000):
    """Deterministic bucket 0..buckets-1 of the key: the first 32 bits of
    md5("seed:key"). A hash of the key (unlike ``randomSplit``) is stable under
    repartitioning and recomputation, so a lost partition is rebuilt into the
    same split; md5 also exists in SQL engines, so the split is checkable."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def split_column(key: str = "IDpol", seed: int = 42, test_fraction: float = 0.2, rule: str = "hash"):
    """J1: 'test' / 'train' from a hash bucket of the key; rule="modulo"
    (key % 5 == 0) is the simplest engine-independent alternative."""
    if rule == "modulo":
        is_test = (F.col(key) % int(round(1 / test_fraction))) == 0
    else:
        is_test = key_bucket(key, seed) < int(round(test_fraction * 10000))
    return F.when(is_test, "test").otherwise("train")


def fold_column(key: str = "IDpol", seed: int = 42, k: int = 5):
    """Shuffled K-fold assignment 0..k-1 from a hash bucket of the key."""
    return (key_bucket(key, seed + 1, 10000 * k) % k).cast("int")


def split(df: DataFrame, key: str = "IDpol", seed: int = 42, test_fraction: float = 0.2,
          rule: str = "hash") -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("_split", split_column(key, seed, test_fraction, rule))
    return (tagged.where(F.col("_split") == "train").drop("_split"),
            tagged.where(F.col("_split") == "test").drop("_split"))
