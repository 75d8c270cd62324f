"""Label codes kept as tables, for columns with any number of classes.

`features.fit_encoder` keeps the classes in the fitted model, which suits a few
thousand.  Here they stay distributed: classes are numbered over one global order and
stored as (class, code); rows find their code by a join that no class can overload.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from retentia.operators.skew import attach_unique
from retentia.sources.staging import release, stage


@dataclass(frozen=True)
class LabelTables:
    """Where the code tables of some columns are stored, one folder per column."""

    folder: str
    columns: tuple

    def table(self, spark: SparkSession, column: str) -> DataFrame:
        return spark.read.schema("class string, code long").parquet(f"{self.folder}/{column}")


def class_text(column: str):
    """A value as its class; a null is a class of its own, as text 'None'."""
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def numbered(classes: DataFrame, parts: int | None = None) -> DataFrame:
    """(class, code): distinct classes in their global order, counted from 0.

    The classes are dealt out by ranges and staged; every range is numbered on its own
    and shifted by the sizes of the ranges before it.  Only those sizes, one row per
    range, are ordered in one task.
    """
    parts = parts or int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        classes.repartitionByRange(parts, "class").withColumn("_part", F.spark_partition_id()), "classes"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("_part").orderBy("class")
    ordered = ranged.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(shifts), "_part")
    codes = stage(ordered.select("class", (F.col("_at") + F.col("_shift")).alias("code")), "codes")
    release(ranged)
    return codes


def fit_label_tables(df: DataFrame, columns, folder: str) -> LabelTables:
    """Number the classes of each column and store them under `folder`, replacing earlier ones."""
    for column in columns:
        codes = numbered(df.select(class_text(column).alias("class")).distinct())
        codes.write.mode("overwrite").parquet(f"{folder}/{column}")
        release(codes)
    return LabelTables(folder, tuple(columns))


def encode_by_tables(df: DataFrame, tables: LabelTables, strict: bool = False) -> DataFrame:
    """`df` with the columns of `tables` replaced by their codes, as whole numbers.

    A class not seen in fitting gets code 0, or fails the job when `strict`.
    """
    names = df.columns
    for column in tables.columns:
        codes = tables.table(df.sparkSession, column).withColumnRenamed("class", "_class")
        coded = attach_unique(df.withColumn("_class", class_text(column)), codes, "_class")
        unseen = F.raise_error(F.concat(F.lit(f"Unseen label of {column}: "), F.col("_class"))) if strict else F.lit(0)
        df = coded.withColumn(column, F.coalesce("code", unseen.cast("long"))).select(*names)
    return df
