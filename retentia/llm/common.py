"""Helpers the operators share: tables, skew-safe lookups, distributed running sums."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from retentia.sources.staging import release, stage

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
HOT_SHARE = 1000  # a key with more than 1/1000 of all rows is hot


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_and_release(df: DataFrame, previous: DataFrame, name: str) -> DataFrame:
    """`df` staged; then the staged frame `previous`, which `df` was made from, is deleted."""
    staged = stage(df, name)
    release(previous)
    return staged


def free_name(df: DataFrame, base: str) -> str:
    """`base`, with underscores added until no column of `df` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(facts: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of `facts` with `lookup`, which has one row per non-null `key`.

    Keys with more than 1/1000 of the fact rows are joined by broadcast: there are
    fewer than 1,000 of them, whatever the size of the data.  All others are
    joined by shuffle, and none of them holds more than 1/1000 of the rows.
    Facts with a null key keep null values.  `facts` is read three times and
    `lookup` twice: pass tables or staged frames.
    """
    total = facts.agg(F.count("*")).scalar()
    hot = (
        facts.where(F.col(key).isNotNull()).groupBy(key).count()
        .where(F.col("count") * F.lit(HOT_SHARE) > total).select(key)
    )
    found = lookup.join(F.broadcast(hot), key)
    values = [c for c in lookup.columns if c != key]
    warm = facts.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti")
    columns = [*facts.columns, *values]
    parts = [
        warm.join(lookup, key, "left").select(*columns),
        facts.join(F.broadcast(hot), key, "left_semi")
        .join(F.broadcast(found), key, "left").select(*columns),
        facts.where(F.col(key).isNull())
        .select("*", *[F.lit(None).cast(lookup.schema[c].dataType).alias(c) for c in values]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def running_sums(df: DataFrame, order: list, sums: dict, within: str | None = None) -> DataFrame:
    """Add, per name in `sums`, the sum of its column over all rows up to this one.

    Rows are ordered by the columns `order` within each value of `within` (not
    null).  They are dealt out by ranges of the order and staged; each range is
    summed on its own and shifted by the totals of the ranges before it.  Only
    those totals, one row per range and group, are ordered together.  Rows that
    are equal in all of `order` may swap places.
    """
    spark = df.sparkSession
    group = [within] if within else []
    ranged = stage(
        df.repartitionByRange(partitions(spark), *group, *order)
        .withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    before = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        ranged.groupBy(*group, "_part")
        .agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
        .select(*group, "_part", *[
            F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums
        ])
    )
    upto = (
        Window.partitionBy("_part", *group).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = ranged.select(
        "*", *[F.sum(c).over(upto).alias(f"_i_{n}") for n, c in sums.items()]
    )
    return inside.join(shifts, ["_part", *group]).select(
        *df.columns, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums]
    )
