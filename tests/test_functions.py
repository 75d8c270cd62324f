import pytest
from pyspark.sql import functions as F

from conftest import rows
from retentia import schema as S
from retentia.functions.advice import recommendations
from retentia.functions.bands import (
    class_name, risk_band, senior_label, tenure_cohort, threshold_class,
)
from retentia.functions.exact import money_avg, money_sum, percent, rounded_ratio


def test_ratios_round_halves_away_from_zero(spark):
    df = spark.createDataFrame(
        [(1, 8), (-1, 8), (1005, 1000), (1, 3), (5, 0), (None, 4)], "a long, b long")
    got = [r[0] for r in df.select(rounded_ratio("a", "b")).collect()]
    assert got == [0.13, -0.13, 1.01, 0.33, None, None]
    assert rows(df.where("a = 1 and b = 3").select(percent("a", "b"))) == [(33.33,)]


def test_ratio_holds_beyond_64_bits(spark):
    df = spark.range(1).selectExpr("cast('123456789012345678901234.5' as decimal(34,6)) a",
                                   "cast(1000000000000 as bigint) b")
    assert rows(df.select(rounded_ratio("a", "b"))) == [(123456789012.35,)]


def test_money_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,), (float("nan"),)], "m double")
    assert rows(df.agg(money_sum("m"), money_avg("m"))) == [(0.3, 0.15)]
    assert rows(df.where("m > 5 and m < 6").agg(money_sum("m"), money_avg("m"))) == [(None, None)]


@pytest.mark.parametrize("amount", [1e18, float("inf")])
def test_money_that_does_not_fit_is_an_error(spark, amount):
    with pytest.raises(Exception, match="CAST|NUMERIC|overflow"):
        spark.createDataFrame([(amount,), (5.0,)], "m double").agg(money_sum("m")).collect()


def test_cohort_edges(spark):
    months = [0, 1, 12, 13, 24, 25, 48, 49, -1, None]
    df = spark.createDataFrame([(m,) for m in months], "t int").select(tenure_cohort(F.col("t")))
    new, second, third = [name for _, _, name in S.COHORTS]
    assert [r[0] for r in df.collect()] == [
        new, new, new, second, second, third, third, S.LOYAL, S.LOYAL, S.LOYAL]
    between = spark.range(1).select(tenure_cohort(F.lit(12.5)))
    assert rows(between) == [(S.LOYAL,)]


def test_bands_and_classes(spark):
    df = spark.createDataFrame(
        [(p,) for p in (0.3999, 0.40, 0.4999, 0.5, 0.6999, 0.70)], "p double")
    got = rows(df.select(risk_band(F.col("p")), threshold_class(F.col("p"))))
    assert got == [("LOW", 0), ("MEDIUM", 0), ("MEDIUM", 0), ("MEDIUM", 1), ("MEDIUM", 1), ("HIGH", 1)]


def test_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "f int")
    got = rows(df.select(senior_label(F.col("f")), class_name(F.col("f"))))
    assert got == [("Non-Senior", "Retained"), ("Senior", "Churned"), ("Non-Senior", None),
                   ("Non-Senior", None)]


BASE = dict(Contract="One year", PaymentMethod="Mailed check", InternetService="DSL",
            tenure=12, MonthlyCharges=80.0, p=0.9)


@pytest.mark.parametrize("change, texts", [
    ({}, [S.ADVICE_STABLE]),
    ({"Contract": "Month-to-month"}, [S.ADVICE_CONTRACT]),
    ({"PaymentMethod": "Electronic check"}, [S.ADVICE_PAYMENT]),
    ({"InternetService": "Fiber optic", "p": 0.5}, [S.ADVICE_STABLE]),
    ({"InternetService": "Fiber optic", "p": 0.5001}, [S.ADVICE_FIBER]),
    ({"tenure": 11}, [S.ADVICE_NEW]),
    ({"MonthlyCharges": 80.01}, [S.ADVICE_SPEND]),
    ({"Contract": None, "tenure": None}, [S.ADVICE_STABLE]),
    ({"Contract": "Month-to-month", "PaymentMethod": "Electronic check",
      "InternetService": "Fiber optic", "tenure": 1, "MonthlyCharges": 99.0},
     [S.ADVICE_CONTRACT, S.ADVICE_PAYMENT, S.ADVICE_FIBER, S.ADVICE_NEW, S.ADVICE_SPEND]),
])
def test_recommendations(spark, change, texts):
    row = {**BASE, **change}
    df = spark.createDataFrame(
        [tuple(row.values())],
        "Contract string, PaymentMethod string, InternetService string, tenure int, "
        "MonthlyCharges double, p double")
    assert df.select(recommendations(F.col("p"))).first()[0] == texts
