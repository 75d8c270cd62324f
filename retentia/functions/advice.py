"""Retention advice for a scored customer."""

from pyspark.sql import Column, functions as F

from retentia import schema as S


def recommendations(prob: Column) -> Column:
    """Array of advice texts from the customer's own columns and its risk.

    All rules that hold are listed in a fixed order; a customer for whom none
    holds gets the 'stable' text.
    """
    rules = [
        (F.col("Contract") == "Month-to-month", S.ADVICE_CONTRACT),
        (F.col("PaymentMethod") == "Electronic check", S.ADVICE_PAYMENT),
        ((F.col("InternetService") == "Fiber optic") & (prob > 0.5), S.ADVICE_FIBER),
        (F.col("tenure") < 12, S.ADVICE_NEW),
        (F.col("MonthlyCharges") > 80, S.ADVICE_SPEND),
    ]
    fired = F.array_compact(F.array(*[F.when(rule, text) for rule, text in rules]))
    return F.when(F.size(fired) == 0, F.array(F.lit(S.ADVICE_STABLE))).otherwise(fired)
