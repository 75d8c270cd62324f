"""Distinct customers from sketches that are stored and added up.

The exact count needs all customers of a period together.  A HyperLogLog sketch per
day and group is a few kilobytes whatever the rows, and sketches of any days add up to
that of the period.
"""

import math

from pyspark.sql import DataFrame, functions as F

LG_K = 12  # 2^12 registers


def sketches(facts: DataFrame, by, key: str = "customerID", lg_k: int = LG_K) -> DataFrame:
    """`by` columns and the sketch of the distinct keys of each group; null keys count nowhere.

    Rows are sketched in every task before the shuffle, so a group with most of the
    rows costs one sketch per task.
    """
    text = F.col(key).cast("string")
    return facts.groupBy(*by).agg(F.hll_sketch_agg(text, F.lit(lg_k)).alias("sketch"))


def distinct_estimate(stored: DataFrame, by=()) -> DataFrame:
    """`by` columns and the estimated distinct keys over all sketches of a group."""
    return stored.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("customers")
    )


def error_bound(n: int, lg_k: int = LG_K, deviations: float = 4.0) -> float:
    """How far an estimate of n may lie off: `deviations` standard errors, at least one customer."""
    return max(1.0, deviations * 1.04 / math.sqrt(2**lg_k) * n)
