"""Headline figures of the customer base."""

from pyspark.sql import DataFrame, functions as F

from retentia.functions.exact import money, money_sum, percent, rounded_ratio


CHARGE = money("MonthlyCharges")
PARTS = {
    "n": "count(*)",
    "lost": "coalesce(sum(Churn), 0)",
    "charges": f"sum({CHARGE})",
    "charged": f"count({CHARGE})",
    "at_risk": f"sum({CHARGE}) FILTER (WHERE Churn = 1)",
}


def _figures(part: dict) -> list:
    """The scalar figures from SQL for their parts."""
    return [
        F.expr(part["n"]).alias("total_customers"),
        F.expr(part["lost"]).alias("churned"),
        F.expr(f"{part['n']} - {part['lost']}").alias("retained"),
        percent(part["lost"], part["n"]).alias("churn_rate_pct"),
        rounded_ratio(part["charges"], part["charged"]).alias("avg_monthly"),
        F.expr(f"CAST(round({part['at_risk']}, 2) AS double)").alias("revenue_at_risk"),
    ]


def kpi_bundle(customers: DataFrame) -> DataFrame:
    """All scalar figures in one pass; zero customers give 0 and null rates."""
    return customers.agg(*_figures(PARTS))


def kpi_by_contract(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy(F.col("Contract").alias("contract"))
        .agg(F.count("*").alias("total"), percent("sum(Churn)", "count(*)").alias("churn_pct"))
        .orderBy(F.desc("churn_pct"), "contract")
    )


def kpi_record(customers: DataFrame) -> DataFrame:
    """The bundle as one record with the contracts nested, highest rate first.

    One pass over the customers: the totals are sums over the per-contract rows,
    and the nested list has one entry per contract type.
    """
    per_contract = customers.groupBy("Contract").agg(
        *[F.expr(sql).alias(name) for name, sql in PARTS.items()]
    )
    rate = percent("lost", "n")
    entry = F.struct(
        (-rate).alias("order"), F.col("Contract").alias("contract"),
        F.col("n").alias("total"), rate.alias("churn_pct"),
    )
    totals = {name: f"sum({name})" for name in PARTS}
    totals.update({name: f"coalesce(sum({name}), 0)" for name in ("n", "lost")})
    return per_contract.agg(
        *_figures(totals),
        F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(e["contract"].alias("contract"), e["total"].alias("total"),
                               e["churn_pct"].alias("churn_pct")),
        ).alias("by_contract"),
    )


def kpi_text(customers: DataFrame) -> DataFrame:
    """The figures as display text: 1,234 / 26.54% / $139,130."""
    kpis = kpi_bundle(customers)
    return kpis.select(
        F.format_number("total_customers", 0).alias("total_customers"),
        F.format_number("churned", 0).alias("churned"),
        F.format_number("retained", 0).alias("retained"),
        F.concat(F.col("churn_rate_pct").cast("string"), F.lit("%")).alias("churn_rate"),
        F.concat(F.lit("$"), F.format_number(F.round("revenue_at_risk", 0), 0))
        .alias("revenue_at_risk"),
    )


def revenue_at_risk(customers: DataFrame) -> DataFrame:
    """Monthly charges of the churned customers."""
    return customers.where("Churn = 1").agg(money_sum("MonthlyCharges").alias("revenue_at_risk"))
