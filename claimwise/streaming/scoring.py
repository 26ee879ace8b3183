"""Scoring a stream of policies with fitted state.

The reference is batch-only (no watermarks, windows or stateful operators);
what carries over to Structured Streaming is the stateless part: once codes,
fill values, density thresholds and a model are fitted on a batch, the
feature columns and the prediction are row-wise expressions, so they apply
unchanged to ``readStream`` input. Nothing here keeps streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import glm
from ..sources.tables import POLICY_SCHEMA


def read_policy_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1) -> DataFrame:
    """A streaming policy source with the fixed schema (no inference)."""
    r = spark.readStream.schema(POLICY_SCHEMA).option("maxFilesPerTrigger", max_files)
    return r.option("header", True).csv(path) if fmt == "csv" else r.parquet(path)


def score_stream(stream: DataFrame, state: feat.FeatureState, model: glm.FittedGLM) -> DataFrame:
    """Fitted features + model prediction per row; no aggregation, no state."""
    fe, _ = feat.engineer(stream, state=state)
    return model.predict(glm.model_frame(fe)).withColumn("scored_at", F.current_timestamp())
