"""Frequency GLMs (L1-L3 on Spark ML), post-processing (L4), scoring (L5),
importance (L6) and feature assembly (L7).

The reference fits boosted trees; the GLM family here is the Spark ML
estimator for the same objectives (Poisson / Tweedie with log link and a
log-exposure offset). ``boost.py`` has the tree version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import active_session, materialize, parallelism
from .features import apply_codes, model_columns, segment_codes
from .target import TargetPrep, to_counts


def model_frame(features: DataFrame, first_appearance: DataFrame | None = None) -> DataFrame:
    """Numeric-only feature frame (segment codes applied; key/target kept).

    Default: BM_Segment in bin order and RiskSegment in lexical order (the
    modules' category codes). ``first_appearance``: a code table from
    ``fit_codes(train, ["RiskSegment"], order="first")`` (the notebook's
    factorize path), fitted once and applied to every split."""
    if first_appearance is None:
        return segment_codes(features)
    # code-table join in place of the column (broadcast after the vocabulary check), no self-join
    return segment_codes(apply_codes(features, first_appearance, ["RiskSegment"]), risk=False)


def assembler(cols: Sequence[str], out: str = "features_raw") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


@dataclass
class FittedGLM:
    name: str
    pipeline: PipelineModel
    prep: TargetPrep
    feature_cols: list[str]
    nonnegative: bool = False
    offset_at_predict: bool = False

    @property
    def glm(self) -> GeneralizedLinearRegressionModel:
        return self.pipeline.stages[-1]

    def predict(self, df: DataFrame, key: str = "IDpol", actual: str = "ClaimNb") -> DataFrame:
        """(key, actual, predicted) where predicted = min(rate, 1) x exposure_adj
        (rate predicted without the offset unless ``offset_at_predict``)."""
        t = self.prep.transform(df)
        if not self.offset_at_predict:
            t = t.withColumn("offset", F.lit(0.0))
        s = self.pipeline.transform(t)
        if self.prep.exposure_col is None:
            pred = F.col("prediction")
            if self.nonnegative:
                pred = F.greatest(pred, F.lit(0.0))
        else:
            pred = to_counts(F.col("prediction"), F.col("exposure_adj"), self.nonnegative)
        return s.select(key, F.col(actual).cast("bigint").alias("actual"), pred.alias("predicted"))

    def importance(self) -> DataFrame:
        """|standardised coefficient| normalised to sum 1, as (model, feature, importance)."""
        coefs = [abs(float(c)) for c in self.glm.coefficients]     # one number per feature (model state)
        tot = sum(coefs) or 1.0
        rows = [(self.name, f, c / tot) for f, c in zip(self.feature_cols, coefs)]
        return active_session().createDataFrame(rows, "model string, feature string, importance double")

    def save(self, path: str) -> None:
        """Spark ML writer (pipeline with assembler, scaler, GLM), and beside it the
        target preparation, the columns and the clamp as one row of JSON."""
        import json
        self.pipeline.write().overwrite().save(path)
        meta = {"version": 1, "name": self.name, "prep": asdict(self.prep), "feature_cols": self.feature_cols, "nonnegative": self.nonnegative,
                "offset_at_predict": self.offset_at_predict}
        active_session().createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, path: str) -> "FittedGLM":
        import json
        meta = json.loads(active_session().read.text(f"{path}/state").first()[0])
        if meta.pop("version") != 1:
            raise ValueError(f"{path}: another version of a saved model")
        return cls(meta["name"], PipelineModel.load(path), TargetPrep(**meta["prep"]), meta["feature_cols"], meta["nonnegative"], meta["offset_at_predict"])


@dataclass
class Standardised:
    """Rows with their standardised ``features``, written once and read by every pass of every fit, and the two
    fitted stages that make them. The raw columns of the model are left out."""
    stages: list
    rows: DataFrame


def standardised(train: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> Standardised:
    first = assembler(cols)
    raw = first.transform(train)
    scaler = StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True).fit(raw)
    rows = scaler.transform(raw).select(*dict.fromkeys(c for c in keep if c in train.columns), "features")
    return Standardised([first, scaler], materialize(rows, "glm-features", min_partitions=parallelism(train.sparkSession)))


def fit_glm(train: DataFrame, name: str, family: str = "poisson", variance_power: float = 1.5,
            exposure_col: str | None = "Exposure", mode: str = "actuarial", reg_param: float = 1e-4,
            max_iter: int = 50, feature_cols: Sequence[str] | None = None, key: str = "IDpol",
            target_col: str = "ClaimNb", scaled: Standardised | None = None) -> FittedGLM:
    """L1 (no exposure), L2 (Poisson + offset), L3 (Tweedie p=1.5 + offset).

    mode="actuarial" (default): claim count as label with the log-exposure
    offset; mode="reference": the reference's capped, floored rate as label
    with the offset as well (exposure counted twice, SURVEY Q3).

    Features are standardised and lightly ridge-penalised (the partitioned
    flags are collinear). The Tweedie fit drops the 1e-6 label floor, which
    the IRLS start cannot use (SURVEY §7.6); the floor stays for Poisson.

    Every pass of the fit reads standardised vectors written once; ``scaled``: those of
    these rows and columns from an earlier call, with the target and exposure columns."""
    cols = list(feature_cols or [c for c in model_columns(train) if c not in (key, target_col)])
    floor = None if family == "tweedie" else 1e-6
    prep = TargetPrep.fit(train, exposure_col, target_col, mode, floor)
    scaled = scaled or standardised(train, cols, [target_col, *([exposure_col] if exposure_col else [])])
    data = prep.transform(scaled.rows)
    kwargs = dict(featuresCol="features", labelCol="target", link="log", regParam=reg_param, maxIter=max_iter)
    if exposure_col is not None:
        kwargs["offsetCol"] = "offset"
    if family == "tweedie":
        glm = GeneralizedLinearRegression(family="tweedie", variancePower=variance_power, linkPower=0.0,
                                          **{k: v for k, v in kwargs.items() if k != "link"})
    else:
        glm = GeneralizedLinearRegression(family="poisson", **kwargs)
    model = PipelineModel([*scaled.stages, glm.fit(data)])
    return FittedGLM(name, model, prep, cols, nonnegative=(family == "tweedie"))


def load_glm(path: str, name: str, prep: TargetPrep, feature_cols: Sequence[str], nonnegative: bool = False) -> FittedGLM:
    return FittedGLM(name, PipelineModel.load(path), prep, list(feature_cols), nonnegative)


def ranked_importance(imp: DataFrame, top: int | None = None) -> DataFrame:
    """H1/H3/H4: sorted by importance desc (feature breaks ties); with ``top``,
    the first ``top`` per model by one aggregate (buffer and window hold one
    model's feature list, bounded by the feature count)."""
    if top is not None:
        first = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature")))
        kept = imp.groupBy("model").agg(F.slice(first, 1, top).alias("_t"))
        return kept.select("model", F.posexplode("_t").alias("_p", "_f")).select(
            "model", F.col("_f.feature").alias("feature"), (-F.col("_f.i")).alias("importance"), (F.col("_p") + 1).alias("rank"))
    w = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return imp.withColumn("rank", F.row_number().over(w))
