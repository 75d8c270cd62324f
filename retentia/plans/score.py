"""Scoring of customers: probability, class, risk band, advice."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from retentia.functions.advice import recommendations
from retentia.functions.bands import risk_band, threshold_class
from retentia.plans.train import predict_proba


def with_rules(scored: DataFrame, score: str = "score") -> DataFrame:
    """Scored customers with the columns of a prediction.

    Class, band and advice look at the unrounded probability.
    """
    p = F.col(score)
    return scored.withColumns({
        "churn_probability": F.round(p, 4),
        "churn_prediction": threshold_class(p),
        "risk_level": risk_band(p),
        "recommendations": recommendations(p),
    }).drop(score)


def score_customers(model: PipelineModel, df: DataFrame, keep=("customerID",)) -> DataFrame:
    """Predictions for every row of a batch or streaming frame.

    Narrow from end to end: encoding, trees and rules run in the scan's tasks.
    """
    columns = ["churn_probability", "churn_prediction", "risk_level", "recommendations"]
    return with_rules(predict_proba(model, df)).select(*keep, *columns)
