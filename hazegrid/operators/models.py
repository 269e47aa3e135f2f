"""Fit and score classifiers from ``pyspark.ml``."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_model(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    estimator: Estimator,
    params: Mapping[str, object] | None = None,
) -> tuple[Model, float]:
    """Fitted model and the seconds it took. ``params`` are set by name."""
    chosen = {estimator.getParam(k): v for k, v in (params or {}).items()}
    chosen[estimator.getParam("labelCol")] = label
    started = time.perf_counter()
    model = estimator.copy(chosen).fit(_assemble(train, features))
    return model, time.perf_counter() - started


def predict(df: DataFrame, features: Sequence[str], model: Model) -> DataFrame:
    return model.transform(_assemble(df, features))


def score_model(df: DataFrame, features: Sequence[str], label: str, model: Model) -> DataFrame:
    """Mean accuracy, one row."""
    predicted = predict(df, features, model)
    hit = (F.col("prediction") == F.col(label).cast("double")).cast("double")
    return predicted.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
