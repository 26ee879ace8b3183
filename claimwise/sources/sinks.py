"""Sinks: CSV of top errors (A6), the comparison summary (A7) and model
persistence (A8). Writes are distributed (one file per partition); nothing
is gathered on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header CSV. ``single_file`` only for small, bounded results (top-k)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def summary_table(metrics: DataFrame, importance: DataFrame | None, key_metrics: Sequence[str],
                  top_features: int = 10) -> DataFrame:
    """Long-form comparison summary (section, model, name, value):
    the key metrics of every model plus each model's top features."""
    m = metrics.select("model", *key_metrics).unpivot(["model"], list(key_metrics), "name", "value") \
               .select(F.lit("metrics").alias("section"), "model", "name", F.col("value").cast("double"))
    if importance is None:
        return m
    from ..operators.glm import ranked_importance
    top = ranked_importance(importance, top_features).select(
        F.lit("top_features").alias("section"), "model", F.col("feature").alias("name"),
        F.col("importance").cast("double").alias("value"))
    return m.unionByName(top)


def write_summary(summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = summary.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
