"""Typing and cleaning of raw customer records."""

from pyspark.sql import Column, DataFrame, functions as F

from retentia.functions.bands import yes_flag

# What counts as a number in a text column.  Spark's own cast would also take
# Java spellings such as '1d' and '1f'.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"^(?i)[+-]?inf(inity)?$"


def coerce_numeric(col: Column) -> Column:
    """Text to double; null for blanks and for anything that is not a number.

    Infinity must be spelled out: digits too large for a double give null.
    """
    text = col.cast("string")
    value = text.try_cast("double")
    finite = F.when(F.abs(value) != float("inf"), value)
    return F.when(text.rlike(NUMBER), finite).when(text.rlike(INFINITE), value)


def clean_customers(raw: DataFrame) -> DataFrame:
    """Drop customers without a usable TotalCharges and type the flags.

    Other columns pass through.  One narrow projection and filter: no shuffle.
    """
    typed = {"TotalCharges": coerce_numeric(F.col("TotalCharges"))}
    if "Churn" in raw.columns:
        typed["Churn"] = yes_flag(F.col("Churn"))
    if "SeniorCitizen" in raw.columns:
        typed["SeniorCitizen"] = F.col("SeniorCitizen").cast("int")
    return raw.withColumns(typed).na.drop(subset=["TotalCharges"])
