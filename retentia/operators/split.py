"""Stratified train/test split by hash of the key."""

from pyspark.sql import DataFrame, Window, functions as F

from retentia.operators.sampling import hash_key

PREFIX = 4  # hex digits: 65,536 buckets per class


def stratified_split(
    df: DataFrame, test_fraction: float = 0.2, label: str = "Churn",
    key: str = "customerID", seed: int = 42,
) -> DataFrame:
    """Add `is_test`: per class, the ceil(fraction * rows) smallest hashes are 1.

    Same result as numbering every row of a class in hash order, without sending
    a class through one task: rows are counted per hash prefix, the prefix the
    cut falls into is found on those counts (at most 65,536 per class), and only
    the rows of that one prefix are ranked.  The cut is then one value per class,
    and marking the rows needs no shuffle.  Rows whose label is not 0 or 1 stay
    unmarked (null).  `df` is read three times: pass a table or a staged frame.
    """
    digest = hash_key(seed, key)
    rank_by = F.struct(digest.alias("h"), F.col(key).alias("k"))
    keyed = df.where(F.col(label).isin(0, 1)).select(
        F.col(label).alias("label"), rank_by.alias("r"),
        F.substring(digest, 1, PREFIX).alias("prefix"),
    )

    per_prefix = keyed.groupBy("label", "prefix").count()
    in_order = Window.partitionBy("label").orderBy("prefix")
    whole = Window.partitionBy("label")
    cut_prefix = (
        per_prefix.select(
            "label", "prefix", "count",
            F.sum("count").over(in_order).alias("upto"),
            F.ceil(F.sum("count").over(whole) * F.lit(str(test_fraction)).cast("decimal(10,8)"))
            .alias("wanted"),
        )
        .where((F.col("wanted") <= F.col("upto")) & (F.col("wanted") > F.col("upto") - F.col("count")))
        .select("label", "prefix", (F.col("wanted") - F.col("upto") + F.col("count")).alias("nth"))
    )

    # One row per class (0 and 1), so both frames below are safe to broadcast.
    numbered = Window.partitionBy("label").orderBy("r")
    cut = (
        keyed.join(F.broadcast(cut_prefix), ["label", "prefix"])
        .withColumn("n", F.row_number().over(numbered))
        .where(F.col("n") == F.col("nth"))
        .select(F.col("label").alias(label), F.col("r").alias("_cut"))
    )
    is_test = F.when(F.col(label).isin(0, 1), F.coalesce(rank_by <= F.col("_cut"), F.lit(False)))
    return (
        df.join(F.broadcast(cut), label, "left")
        .withColumn("is_test", is_test.cast("int"))
        .select(*df.columns, "is_test")
    )


def hash_split(
    df: DataFrame, test_fraction: float = 0.2, key: str = "customerID", seed: int = 42,
) -> DataFrame:
    """Add `is_test` from the hash alone: no shuffle and no pass over the data.

    Class ratios and the test share are met up to sampling noise, which is far
    below a percent from a million rows on.
    """
    bound = int(test_fraction * 16**8)
    value = F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", (value < bound).cast("int"))
