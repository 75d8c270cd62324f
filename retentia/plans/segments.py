"""The segment summary kept up to date batch by batch.

What is stored per segment can be added up: counts, and sums as exact decimals.
Averages and rates are derived on reading, so folding batches in gives the figures
of one build over all customers, to the last digit and in any order.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from retentia.functions.exact import money, rounded_ratio
from retentia.sources import files

KEYS = ["Contract", "InternetService"]
SUMS = ["total_customers", "churned", "charges", "charged", "months", "with_months"]
TABLE = "segment_state"
BATCHES = "segment_batches"


def segment_state(customers: DataFrame) -> DataFrame:
    """Counts and sums by contract and service; rows with a null key are left out."""
    charge = money("MonthlyCharges")
    return (
        customers.where("Contract IS NOT NULL AND InternetService IS NOT NULL").groupBy(*KEYS)
        .agg(
            F.count("customerID").alias("total_customers"),
            F.sum("Churn").cast("long").alias("churned"),
            F.expr(f"CAST(sum({charge}) AS decimal(38,6))").alias("charges"),
            F.expr(f"count({charge})").alias("charged"),
            F.sum("tenure").cast("long").alias("months"),
            F.count("tenure").alias("with_months"),
        )
    )


def merged(*states: DataFrame) -> DataFrame:
    """The state of all customers behind several states; each must hold other customers."""
    together = states[0]
    for more in states[1:]:
        together = together.unionByName(more)
    return together.groupBy(*KEYS).agg(
        *[F.sum(c).cast("decimal(38,6)" if c == "charges" else "long").alias(c) for c in SUMS]
    )


def segment_figures(state: DataFrame) -> DataFrame:
    """The columns of the stored segment summary."""
    return state.select(
        *KEYS, "total_customers", "churned",
        rounded_ratio("charges", "charged").alias("avg_monthly"),
        rounded_ratio("months", "with_months").alias("avg_tenure"),
    )


def fold_batch(spark: SparkSession, path: str, customers: DataFrame, batch: str) -> bool:
    """Add a batch of new customers to the state stored under `path`.

    State and list of batches are replaced together, so a batch that is sent again,
    after a failure or by mistake, is not added twice: False is returned then.
    """
    stored = files.current_places(spark, path)
    state = segment_state(customers)
    done = spark.createDataFrame([(batch,)], "batch string")
    if stored:
        before = files.read_tables(spark, path, [TABLE, BATCHES])
        if before[BATCHES].where(F.col("batch") == batch).limit(1).count():
            return False
        state, done = merged(before[TABLE], state), before[BATCHES].unionByName(done)
    files.write_tables({TABLE: state, BATCHES: done.coalesce(1)}, path)
    return True


def stored_figures(spark: SparkSession, path: str) -> DataFrame:
    """Figures of all batches folded in so far."""
    return segment_figures(files.read_tables(spark, path, [TABLE])[TABLE])
