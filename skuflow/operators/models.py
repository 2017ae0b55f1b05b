"""Two-stage demand models on MLlib: does a SKU sell on a day, and how much."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions.clean import log_target, unlog_target


def class_weight(train: DataFrame, label: str = "has_demand") -> DataFrame:
    """Weight positives by negatives/positives; one scalar over the training rows."""
    pos = F.sum(F.col(label))
    ratio = train.agg((F.count(F.lit(1)) - pos) / F.greatest(pos, F.lit(1))).scalar()
    return train.withColumn("_ratio", ratio).withColumn(
        "weight", F.when(F.col(label) == 1, F.col("_ratio")).otherwise(F.lit(1.0))
    ).drop("_ratio")


def fit_classifier(
    rows: DataFrame,
    features: Sequence[str],
    rounds: int = 60,
    depth: int = 7,
    step: float = 0.04,
    validation: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Demand-occurrence model on all grid rows. Needs ``has_demand`` and ``weight``."""
    gbt = GBTClassifier(
        featuresCol="features",
        labelCol="has_demand",
        weightCol="weight",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.6",
        minInstancesPerNode=15,
        seed=seed,
    )
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt]).fit(rows)


def fit_regressor(
    rows: DataFrame,
    features: Sequence[str],
    rounds: int = 60,
    depth: int = 6,
    step: float = 0.04,
    validation: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Quantity model on demand rows; learns log1p(demand)."""
    gbt = GBTRegressor(
        featuresCol="features",
        labelCol="log_demand",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=0.8,
        featureSubsetStrategy="0.6",
        minInstancesPerNode=10,
        seed=seed,
    )
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    labelled = rows.where("demand > 0").withColumn("log_demand", log_target("demand"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt]).fit(labelled)


def with_predictions(rows: DataFrame, classifier: PipelineModel, regressor: PipelineModel) -> DataFrame:
    """Add probability and reg_qty."""
    internal = ("features", "rawPrediction", "prediction", "probability")
    p = (
        classifier.transform(rows)
        .withColumn("_p", vector_to_array("probability")[1])
        .drop(*internal)
        .withColumnRenamed("_p", "p_demand")
    )
    return (
        regressor.transform(p)
        .withColumn("reg_qty", unlog_target("prediction"))
        .drop("features", "prediction")
        .withColumnRenamed("p_demand", "probability")
    )


def blend(alpha: float, base: str = "base_yhat", other: str = "reg_qty") -> Column:
    return F.lit(alpha) * F.col(base) + F.lit(1 - alpha) * F.col(other)


def expected_value(alpha: float, mult: float, power: float, p: str = "probability") -> Column:
    return F.greatest(F.pow(p, F.lit(power)) * blend(alpha) * mult, F.lit(0.0))


def gated(threshold: float, alpha: float, mult: float, p: str = "probability", other: str = "reg_qty") -> Column:
    hit = F.col(p) >= threshold
    return F.when(hit, F.greatest(blend(alpha, other=other) * mult, F.lit(0.0))).otherwise(F.lit(0.0))


def final_prediction(params) -> Column:
    """Prediction by the tuned mode; ``params`` is the row of ``choose_mode``."""
    if params["mode"] == "expected_value":
        return expected_value(params["alpha"] / 1000.0, params["mult"] / 100.0, params["power"] / 100.0)
    return gated(params["thr"] / 1000.0, params["alpha"] / 1000.0, params["mult"] / 100.0)


def importance(model: PipelineModel, features: Sequence[str], spark, k: int = 15) -> DataFrame:
    """Top-k features; the full list has one entry per feature column."""
    gains = [float(g) for g in model.stages[-1].featureImportances.toArray()]
    rows = spark.createDataFrame(list(zip(features, gains)), "feature string, gain double")
    return rows.orderBy(F.desc("gain"), "feature").limit(k)


def save(path: str, classifier: PipelineModel, regressor: PipelineModel, dimension: DataFrame, params: DataFrame) -> None:
    """Models and their lookup tables under one folder."""
    classifier.write().overwrite().save(f"{path}/classifier")
    regressor.write().overwrite().save(f"{path}/regressor")
    dimension.write.mode("overwrite").parquet(f"{path}/baseline")
    params.write.mode("overwrite").json(f"{path}/parameters")


def load(spark, path: str):
    return (
        PipelineModel.load(f"{path}/classifier"),
        PipelineModel.load(f"{path}/regressor"),
        spark.read.parquet(f"{path}/baseline"),
        spark.read.schema("mode string, thr bigint, alpha bigint, mult bigint, power bigint, wape double, bias double").json(f"{path}/parameters"),
    )
