"""Customer, transaction and ticket tables derived from order data.

Input tables: customer, orders, nation, region, events.  A customer's contract
is its market segment, the internet service its region, the payment method its
most frequent order priority; it has churned when it placed no order in the last
365 days of the data.  Column names are those of `schema`; what the order data
do not hold (gender, partner, ...) is left out.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from retentia.functions.exact import rounded_ratio
from retentia.operators.clean import clean_customers
from retentia.operators.skew import join_unique

CENTS = "decimal(18,2)"
CHURN_DAYS = 365
MONTHS = "greatest(tenure, 1)"


SOURCES = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
              "value double, props string",
}


def load(spark: SparkSession, folder: str) -> dict:
    """The source tables as lazily read frames; no job to find out the schema."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")
        for name, schema in SOURCES.items()
    }


def _months_between(first: str, last: str) -> str:
    """SQL of the calendar months from one date column to another."""
    return f"(year({last}) - year({first})) * 12 + month({last}) - month({first})"


def churn_cut(orders: DataFrame, as_of=None):
    """The moment a customer must have ordered since.

    `as_of` saves the extra pass over the order dates when the snapshot date is
    known.
    """
    if as_of is not None:
        end = F.lit(as_of).cast("timestamp_ntz")
    else:
        end = orders.agg(F.max("o_orderdate")).scalar()
    return end - F.expr(f"INTERVAL {CHURN_DAYS} DAYS")


def order_profile(orders: DataFrame, payment: bool, used: str = "true") -> DataFrame:
    """Per customer: first and last order, amount, orders, payment method.

    `used` is the SQL condition for an order to count; the others still show up
    in `last_any`.  All aggregates combine before the shuffle, so a customer with
    any share of the orders is no hot spot.  The payment method needs counts per
    customer and priority first, a second level that is left out when it is not
    asked for.
    """
    base = [
        f"min(o_orderdate) FILTER (WHERE {used}) AS first",
        f"max(o_orderdate) FILTER (WHERE {used}) AS last",
        "max(o_orderdate) AS last_any",
        f"sum(CAST(o_totalprice AS {CENTS})) FILTER (WHERE {used}) AS total",
        f"count_if({used}) AS n",
    ]
    if not payment:
        return orders.groupBy("o_custkey").agg(*map(F.expr, base))
    again = [
        "min(first) AS first", "max(last) AS last", "max(last_any) AS last_any",
        "sum(total) AS total", "sum(n) AS n",
        # An order that does not count must not make its priority a candidate.
        "min_by(o_orderpriority, if(n > 0, struct(-n, o_orderpriority), NULL)) AS PaymentMethod",
    ]
    return (
        orders.groupBy("o_custkey", "o_orderpriority").agg(*map(F.expr, base))
        .groupBy("o_custkey").agg(*map(F.expr, again))
    )


def _attributes(source: dict, service: bool = True) -> DataFrame:
    """customerID, Contract, SeniorCitizen and, if wanted, InternetService."""
    people = source["customer"].selectExpr(
        "c_custkey AS customerID", "c_mktsegment AS Contract",
        "CAST(c_acctbal < 0 AS int) AS SeniorCitizen", "c_nationkey AS n_nationkey",
    )
    if service:
        place = source["nation"].join(
            source["region"].withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
        ).selectExpr("n_nationkey", "r_name AS InternetService")
        people = people.join(place, "n_nationkey", "left")
    return people.drop("n_nationkey")


CUSTOMER_COLUMNS = (
    "customerID", "SeniorCitizen", "tenure", "InternetService", "Contract",
    "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
)


def raw_customers(source: dict, columns=CUSTOMER_COLUMNS, as_of=None) -> DataFrame:
    """Customers as they arrive: TotalCharges and Churn are text.

    Customers without orders stay, with a blank TotalCharges.  Name the columns
    that are needed: Spark prunes scans by itself, but not the lookup of the
    service or the counts behind the payment method.
    """
    profile = order_profile(source["orders"], "PaymentMethod" in columns)
    joined = _attributes(source, "InternetService" in columns).join(
        profile.withColumnRenamed("o_custkey", "customerID"), "customerID", "left"
    ).withColumns({
        "tenure": F.expr(f"coalesce({_months_between('first', 'last')}, 0)"),
        "cut": churn_cut(source["orders"], as_of),
    })
    derived = {
        "MonthlyCharges": rounded_ratio("coalesce(total, 0)", MONTHS),
        "TotalCharges": F.expr("coalesce(CAST(total AS string), ' ')"),
        "Churn": F.expr("if(coalesce(last < cut, true), 'Yes', 'No')"),
    }
    return joined.select(*[derived[c].alias(c) if c in derived else c for c in columns])


def customers(source: dict, columns=CUSTOMER_COLUMNS, as_of=None) -> DataFrame:
    """Cleaned customers with the named columns."""
    needed = [*columns] + [c for c in ("TotalCharges",) if c not in columns]
    return clean_customers(raw_customers(source, needed, as_of)).select(*columns)


def payments(source: dict) -> DataFrame:
    """Transactions without their month number: a plain projection of orders."""
    return source["orders"].selectExpr(
        "o_orderkey AS transaction_id", "o_custkey AS customerID", "o_totalprice AS amount",
        "o_orderpriority AS payment_method",
        "CAST(coalesce(o_orderstatus = 'F', false) AS int) AS paid_on_time", "o_orderdate",
    )


def transactions(source: dict) -> DataFrame:
    """One row per order; month_num counts from the customer's first order."""
    facts = payments(source)
    first = facts.groupBy("customerID").agg(
        F.min("o_orderdate").alias("first"), F.count("*").alias("n_rows")
    )
    return join_unique(facts, first, "customerID", "transaction_id").selectExpr(
        "transaction_id", "customerID", f"{_months_between('first', 'o_orderdate')} + 1 AS month_num",
        "amount", "payment_method", "paid_on_time",
    )


def support_tickets(source: dict) -> DataFrame:
    """Events of type error or click, read as support tickets."""
    return source["events"].where("event_type IN ('error', 'click')").selectExpr(
        "event_id AS ticket_id", "user_id AS customerID", "event_type AS category",
        "CAST(value < 50 AS int) AS resolved",
        "CAST(least(4, floor(value / 50)) + 1 AS int) AS rating",
    )


def training(source: dict, as_of=None) -> DataFrame:
    """Features known at the cut, and whether the customer ordered since.

    Unlike `customers` nothing here looks past the cut except the label.
    Customers without an order before the cut are left out.
    """
    orders = source["orders"]
    cut = churn_cut(orders, as_of)
    profile = order_profile(orders.withColumn("cut", cut), payment=True, used="o_orderdate < cut")
    return (
        profile.where("n > 0")
        .withColumnRenamed("o_custkey", "customerID")
        .join(_attributes(source), "customerID")
        .withColumns({"tenure": F.expr(_months_between("first", "last")), "cut": cut})
        .select(
            "customerID", "SeniorCitizen", "tenure",
            rounded_ratio("total", MONTHS).alias("MonthlyCharges"),
            F.expr("CAST(total AS double) AS TotalCharges"),
            F.expr("n AS n_orders"),
            F.expr("datediff(cut, last) AS recency"),
            "InternetService", "Contract", "PaymentMethod",
            F.expr("CAST(last_any < cut AS int) AS Churn"),
        )
    )


TRAINING_NUMBERS = [
    "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "n_orders", "recency",
]
TRAINING_CATEGORIES = ["InternetService", "Contract", "PaymentMethod"]
