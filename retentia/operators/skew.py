"""Equi-join for a fact side in which a few keys may hold most of the rows."""

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 1000  # hot: more than 1/1000 of all fact rows
SALTS_PER_PART = 4  # several small pieces per task even out where they land


def join_unique(
    facts: DataFrame, lookup: DataFrame, key: str, row_id: str,
    count: str = "n_rows", parts: int | None = None,
) -> DataFrame:
    """Inner join of `facts` with `lookup`, which has one row per key.

    `lookup` also carries `count`, the number of fact rows of its key.  Keys with
    more than 1/1000 of the rows are hot; there cannot be more than 1,000 of
    them, so their list is broadcast.  A hot key gets four salts for each average
    shuffle partition of rows it holds (`parts`, by default the session's
    number): its fact rows are spread over them by row id, and its lookup row is
    repeated once per salt, which adds at most 4 * parts + 1,000 rows.  All other
    rows have salt 0 and join as usual.
    """
    parts = parts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.count("*")).scalar()
    is_hot = F.col(count) * F.lit(HOT_SHARE) > total
    salts = F.when(is_hot, F.ceil(F.col(count) * F.lit(parts * SALTS_PER_PART) / total)).otherwise(1)
    hot = lookup.where(is_hot).select(key, salts.alias("_salts"))

    spread = F.pmod(F.xxhash64(row_id), F.col("_salts"))
    salted = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.coalesce(spread, F.lit(0))
    )
    copies = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    ).drop(count)
    values = [c for c in lookup.columns if c not in (key, count)]
    return salted.join(copies, [key, "_salt"]).select(*facts.columns, *values)


def attach_unique(facts: DataFrame, lookup: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Left join of `facts` with `lookup`, which has one row per key, in one shuffle.

    A key with more than 1/1000 of the fact rows is hot.  There are at most 1,000 of
    them, so their lookup rows are broadcast; their fact rows, like those
    without a key, are dealt evenly over the tasks of the join, where they meet nothing.  No other key holds more than
    1/1000 of the rows.  Facts without a match keep null values.
    """
    parts = parts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.count("*")).scalar()
    hot = facts.groupBy(key).count().where(F.col("count") * F.lit(HOT_SHARE) > total).select(key)
    values = [c for c in lookup.columns if c != key]
    found = hot.join(lookup, key, "left").select(
        key, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    dealt = 1 + F.pmod(F.xxhash64(*facts.columns), F.lit(parts * SALTS_PER_PART).cast("long"))
    marked = facts.join(F.broadcast(found), key, "left").withColumn(
        "_deal", F.when(F.coalesce("_hot", F.col(key).isNull()), dealt).otherwise(0)
    )
    once = lookup.withColumn("_deal", F.lit(0).cast("long"))
    return marked.join(once, [key, "_deal"], "left").select(
        *facts.columns, *[F.coalesce(F.col(f"_hot_{v}"), F.col(v)).alias(v) for v in values]
    )
