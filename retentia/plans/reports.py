"""The retention reports.

Each takes and returns DataFrames.  Groups are few (contract, service, cohort,
...) and all aggregates combine before the shuffle, so what is exchanged and
sorted is one row per group and task, whatever the table size or its skew.
Ties in a sort are broken by the group key.
"""

from pyspark.sql import DataFrame, functions as F

from retentia.functions.bands import senior_label, tenure_cohort
from retentia.functions.exact import (
    money, money_avg, money_sum, percent, rounded_ratio, whole_avg,
)


def _rate():
    return percent("sum(Churn)", "count(*)")


def churn_rate_overall(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count("*").alias("total_customers"),
        F.sum("Churn").alias("churned"),
        _rate().alias("churn_rate_pct"),
    )


def _churn_by(customers: DataFrame, key: str, *more) -> DataFrame:
    return (
        customers.groupBy(key)
        .agg(F.count("*").alias("total"), F.sum("Churn").alias("churned"),
             _rate().alias("churn_pct"), *more)
        .orderBy(F.desc("churn_pct"), key)
    )


def churn_by_contract(customers: DataFrame) -> DataFrame:
    return _churn_by(
        customers, "Contract", money_avg("MonthlyCharges").alias("avg_monthly_charge")
    )


def churn_by_payment(customers: DataFrame) -> DataFrame:
    return _churn_by(customers, "PaymentMethod")


def tenure_cohorts(customers: DataFrame) -> DataFrame:
    labelled = customers.withColumn("tenure_cohort", tenure_cohort(F.col("tenure")))
    return _churn_by(labelled, "tenure_cohort", money_avg("MonthlyCharges").alias("avg_charge"))


def senior_segments(customers: DataFrame) -> DataFrame:
    """Grouped by the flag itself, shown by its label."""
    return (
        customers.groupBy("SeniorCitizen")
        .agg(F.count("*").alias("total"), F.sum("Churn").alias("churned"),
             _rate().alias("churn_pct"), money_avg("MonthlyCharges").alias("avg_monthly"))
        .select(senior_label(F.col("SeniorCitizen")).alias("segment"),
                "total", "churned", "churn_pct", "avg_monthly")
    )


def revenue_at_risk_by_service(customers: DataFrame) -> DataFrame:
    return (
        customers.where("Churn = 1")
        .groupBy("InternetService")
        .agg(F.count("*").alias("churned_customers"),
             money_sum("MonthlyCharges").alias("monthly_revenue_lost"),
             money_avg("MonthlyCharges").alias("avg_charge"))
        .orderBy(F.desc("monthly_revenue_lost"), "InternetService")
    )


def top_risk_customers(customers: DataFrame, k: int = 10) -> DataFrame:
    """Churned customers with the highest charge; each task keeps its own top k."""
    return (
        customers.where("Churn = 1")
        .select("customerID", "Contract", "InternetService", "tenure",
                "MonthlyCharges", "TotalCharges")
        .orderBy(F.desc("MonthlyCharges"), "customerID")
        .limit(k)
    )


def tickets_vs_churn(customers: DataFrame, tickets: DataFrame, k: int = 20) -> DataFrame:
    """Customers with the most tickets and their average rating.

    Tickets are counted per customer before the join, so it never fans out, and
    a customer holding most of the tickets costs one row per task.
    """
    per_customer = tickets.groupBy("customerID").agg(
        F.count("*").alias("n"), F.sum("rating").alias("sum"), F.count("rating").alias("rated")
    )
    # The second aggregation only matters where a customer is listed twice.
    return (
        customers.select("customerID", "Churn", "Contract")
        .join(per_customer, "customerID", "left")
        .groupBy("customerID", "Churn", "Contract")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_tickets"),
             rounded_ratio("sum(sum)", "sum(rated)").alias("avg_rating"))
        .orderBy(F.desc("num_tickets"), "customerID", "Churn", "Contract")
        .limit(k)
    )


def transactions_by_churn(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Customers, transactions, average amount and late share per churn status.

    Transactions shrink to one row per customer before the join; the distinct
    count is over those rows.
    """
    per_customer = transactions.groupBy("customerID").agg(
        F.count("*").alias("n"),
        F.expr(f"sum({money('amount')})").alias("paid"),
        F.expr(f"count({money('amount')})").alias("n_paid"),
        F.count_if(F.col("paid_on_time") == 0).alias("late"),
    )
    return (
        customers.select("customerID", "Churn")
        .join(per_customer, "customerID")
        .groupBy("Churn")
        .agg(F.count_distinct("customerID").alias("customers"),
             F.sum("n").alias("total_transactions"),
             rounded_ratio("sum(paid)", "sum(n_paid)").alias("avg_txn_amount"),
             percent("sum(late)", "sum(n)").alias("late_payment_pct"))
    )


def segment_summary(customers: DataFrame) -> DataFrame:
    """Pre-aggregate by contract and service; rows with a null key are left out."""
    return (
        customers.where("Contract is not null and InternetService is not null")
        .groupBy("Contract", "InternetService")
        .agg(F.count("customerID").alias("total_customers"),
             F.sum("Churn").alias("churned"),
             money_avg("MonthlyCharges").alias("avg_monthly"),
             whole_avg("tenure").alias("avg_tenure"))
    )


def segment_report(summary: DataFrame) -> DataFrame:
    """The stored pre-aggregate with its churn rate."""
    return summary.select(
        "Contract", "InternetService", "total_customers", "churned",
        percent("churned", "total_customers").alias("churn_pct"),
        "avg_monthly", "avg_tenure",
    ).orderBy(F.desc("churn_pct"), "Contract", "InternetService")
