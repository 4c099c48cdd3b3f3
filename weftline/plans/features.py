"""A training set and a pipeline of features and model, by Spark's own learning library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def temporal_features(df: DataFrame, at: str) -> DataFrame:
    """Hour and weekday as points on circles, so that midnight is next to eleven at night, and a mark for weekends."""
    hour, weekday = F.hour(at) * (2 * 3.141592653589793 / 24), F.dayofweek(at) * (2 * 3.141592653589793 / 7)
    return df.withColumns({"hour_cos": F.cos(hour), "hour_sin": F.sin(hour), "weekday_cos": F.cos(weekday), "weekday_sin": F.sin(weekday), "weekend": F.dayofweek(at).isin(1, 7).cast("double")})


def split_by_time(df: DataFrame, at: str, train: float = 0.7, validation: float = 0.15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Earlier rows to learn from, later ones to judge by; the bounds are approximate quantiles of the time."""
    seconds = F.unix_timestamp(F.col(at).cast("timestamp")).cast("double")
    a, b = df.select(seconds.alias("s")).approxQuantile("s", [train, train + validation], 0.001)
    return df.filter(seconds <= a), df.filter((seconds > a) & (seconds <= b)), df.filter(seconds > b)


def pipeline(label: str, numeric: Sequence[str], categories: Sequence[str]) -> Pipeline:
    """Missing numbers by their median, categories one-hot (unseen ones kept), all scaled, a regularised linear model."""
    filled = [f"{c}_filled" for c in numeric]
    stages = [Imputer(inputCols=list(numeric), outputCols=filled, strategy="median")]
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot", handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=[*filled, *(f"{c}_hot" for c in categories)], outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=False)]
    return Pipeline(stages=[*stages, LinearRegression(featuresCol="features", labelCol=label, regParam=0.01)])


def train(df: DataFrame, label: str, numeric: Sequence[str], categories: Sequence[str], path: str | None = None) -> PipelineModel:
    model = pipeline(label, numeric, categories).fit(df.filter(F.col(label).isNotNull()))
    if path:
        model.write().overwrite().save(path)
    return model


def evaluate(model: PipelineModel, df: DataFrame, label: str) -> dict[str, float]:
    out = model.transform(df.filter(F.col(label).isNotNull()))
    return {m: RegressionEvaluator(labelCol=label, metricName=m).evaluate(out) for m in ("rmse", "mae", "r2")}


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
