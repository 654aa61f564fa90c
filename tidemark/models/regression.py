"""Two-column regressors (for instance body-mass index from sex and age)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame


def _assembled(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="_x").transform(df)


def fit_linear(df: DataFrame, inputs: Sequence[str], target: str) -> Model:
    return LinearRegression(featuresCol="_x", labelCol=target, predictionCol="_p", solver="normal").fit(_assembled(df, inputs))


def fit_forest(df: DataFrame, inputs: Sequence[str], target: str, *, trees: int = 50, seed: int = 42) -> Model:
    forest = RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="_p", numTrees=trees, seed=seed)
    return forest.fit(_assembled(df, inputs))


def apply_linear(df: DataFrame, model: Model, inputs: Sequence[str], name: str) -> DataFrame:
    """Apply a fitted regressor to two columns; works for either kind of model."""
    return model.transform(_assembled(df, inputs)).drop("_x").withColumnRenamed("_p", name)
