"""Spark ML pipelines over the campaign preprocessor.

``Pipeline([CampaignPreprocessor, estimator])`` refits the preprocessing with every
fit (no leakage).  The grid search of all models is in ``tuning``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame

from adlift.constants import SEED, TARGET
from adlift.operators.prep import CampaignPreprocessor
from adlift.operators.tuning import GBT_NAME, LR_NAME, RF_NAME


def estimators(label: str = TARGET):
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, elasticNetParam=0.0)
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, seed=SEED, featureSubsetStrategy="all")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=SEED, lossType="squared")
    return {LR_NAME: lr, RF_NAME: rf, GBT_NAME: gbt}


def ml_pipeline(estimator) -> Pipeline:
    return Pipeline(stages=[CampaignPreprocessor(outputCol="features"), estimator])


def fit(train: DataFrame, estimator, params: dict | None = None) -> PipelineModel:
    return ml_pipeline(estimator.copy(params or {})).fit(train)
