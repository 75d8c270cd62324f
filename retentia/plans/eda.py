"""Exploratory aggregates behind the charts.

Groups with a null key are left out here, unlike in the reports.
"""

from pyspark.sql import DataFrame, functions as F

from retentia.functions.bands import class_name
from retentia.functions.exact import percent, share
from retentia.operators.sampling import fixed_size_sample


def contract_rate_raw(customers: DataFrame) -> DataFrame:
    """Churned, total and the unrounded rate per contract."""
    return (
        customers.where("Contract is not null").groupBy("Contract")
        .agg(F.sum("Churn").alias("sum"), F.count("Churn").alias("count"))
        .withColumn("churn_pct", share("`sum`", "`count`") * 100.0)
    )


def mean_rate(customers: DataFrame, key: str) -> DataFrame:
    """Unrounded churn rate in percent per value of `key`."""
    return (
        customers.where(F.col(key).isNotNull()).groupBy(key)
        .agg((share("sum(Churn)", "count(Churn)") * 100.0).alias("churn_pct"))
    )


def mean_rate_rounded(customers: DataFrame, key: str) -> DataFrame:
    return (
        customers.where(F.col(key).isNotNull()).groupBy(key)
        .agg(percent("sum(Churn)", "count(Churn)").alias("churn_pct"))
    )


def share_of_total(customers: DataFrame, key: str = "InternetService") -> DataFrame:
    """Each group's rate as a share of the sum of all rates."""
    rates = mean_rate(customers, key)
    total = rates.agg(F.sum("churn_pct")).scalar()
    return rates.withColumn("share", F.round(F.try_divide("churn_pct", total), 8))


def histogram_by_class(
    customers: DataFrame, value: str = "MonthlyCharges", bins: int = 40
) -> DataFrame:
    """Counts per class and bin of equal width between the smallest and largest value.

    The largest value belongs to the last bin.  The bounds are those of the finite
    values; infinities count in the first or last bin.  Only bins with rows are
    listed; one aggregate pass for the bounds, one for the counts.
    """
    known = customers.where(F.col(value).isNotNull() & ~F.isnan(value))
    low, high = F.col("_b.low"), F.col("_b.high")
    finite = F.when(F.abs(value) < float("inf"), F.col(value))
    bounds = known.agg(F.struct(F.min(finite).alias("low"), F.max(finite).alias("high"))).scalar()
    width = (high - low) / F.lit(float(bins))
    place = (
        F.when(F.col(value) == float("inf"), F.lit(bins - 1))
        .when(F.col(value) == float("-inf"), F.lit(0))
        .otherwise(F.floor(F.try_divide(F.col(value) - low, width)))
    )
    return (
        known.withColumn("_b", bounds)
        .select(
            class_name(F.col("Churn")).alias("status"),
            F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"),
        )
        .groupBy("status", "bin").count()
        .withColumnRenamed("count", "n")
    )


def charges_scatter(customers: DataFrame, n: int = 1500, seed: int = 42) -> DataFrame:
    """Repeatable sample of tenure against monthly charges with the class name."""
    return fixed_size_sample(customers, n, "customerID", seed).select(
        "customerID", "tenure", "MonthlyCharges", class_name(F.col("Churn")).alias("status")
    )
