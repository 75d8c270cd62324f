"""One row per customer and billing month."""

from pyspark.sql import DataFrame, functions as F

from retentia.functions.exact import money


def _months(*more):
    return F.sequence(F.lit(1), F.greatest(F.col("tenure"), F.lit(1), *more))


def billing_month_spine(customers: DataFrame) -> DataFrame:
    """Customer columns repeated for months 1..max(tenure, 1); no shuffle."""
    return customers.select("*", F.explode(_months()).alias("month_num"))


def spine_fill(customers: DataFrame, monthly: DataFrame) -> DataFrame:
    """Spine with `amount` per customer-month, 0 where nothing was paid.

    A customer's months run to the last one paid for where that is after its
    tenure, so the spine holds every amount.

    `monthly` has customerID, month_num, amount and at most one row per customer
    and month.  It is folded to one map per customer, which holds a month at
    most once, and joined before the months are unfolded: the shuffles carry
    customers, not customer-months.
    """
    paid = monthly.groupBy("customerID").agg(
        F.map_from_entries(F.collect_list(F.struct("month_num", "amount"))).alias("paid")
    )
    amount = F.coalesce(F.element_at("paid", F.col("month_num")), F.lit(0.0))
    return (
        customers.join(paid, "customerID", "left")
        .withColumn("month_num", F.explode(_months(F.array_max(F.map_keys("paid")))))
        .withColumn("amount", amount)
        .drop("paid")
    )


def monthly_amounts(transactions: DataFrame) -> DataFrame:
    """Sum of amounts per customer and month."""
    return transactions.groupBy("customerID", "month_num").agg(
        F.expr(f"CAST(sum({money('amount')}) AS double)").alias("amount")
    )
