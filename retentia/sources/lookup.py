"""Customers and facts stored side by side, so that joining them moves no row."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from retentia.sources.files import write_bucketed
from retentia.sources.staging import discard


@dataclass(frozen=True)
class Lookup:
    """Customers and the facts of most of them in equal buckets; the facts of very large ones apart."""

    spark: SparkSession
    name: str
    folder: str

    @property
    def customers(self) -> DataFrame:
        return self.spark.table(f"{self.name}_customers")

    @property
    def facts(self) -> DataFrame:
        return self.spark.table(f"{self.name}_facts")

    @property
    def large_facts(self) -> DataFrame:
        return self.spark.table(f"{self.name}_large")

    def per_customer(self, columns, *aggregates) -> DataFrame:
        """customerID, the customer's `columns` and `aggregates` over its facts.

        Customers without facts are left out.  The buckets are aggregated and joined in
        place.  Only the facts of large customers are shuffled, one row per
        customer and task, and meet their customers by a broadcast of no more rows than buckets.
        """
        people = self.customers.select("customerID", *columns)
        names = [*columns, *self.facts.limit(0).agg(*aggregates).columns]

        def joined(facts, how):
            found = facts.groupBy("customerID").agg(*aggregates).hint(how)
            return people.join(found, "customerID").select("customerID", *names)

        return joined(self.facts, "merge").unionByName(joined(self.large_facts, "broadcast"))

    def drop(self) -> None:
        """Forget the tables and delete their files."""
        for part in ("customers", "facts", "large"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
        discard(self.spark, self.folder)


def write_lookup(customers: DataFrame, facts: DataFrame, folder: str, buckets: int, name: str | None = None) -> Lookup:
    """Store customers and facts for joins by customer, in `buckets` buckets each.

    A bucket is read by one task, so customers with more facts than an average bucket
    holds, at most as many as there are buckets, are kept out: their facts are a plain
    table of any number of files.  `facts` is read twice: pass a stored table.  Facts without
    a customer are left out, as they join with nobody.
    """
    spark = customers.sparkSession
    name = name or f"lookup_{uuid.uuid4().hex}"
    known = facts.where("customerID IS NOT NULL")
    total = known.agg(F.count("*")).scalar()
    large = known.groupBy("customerID").count().where(F.col("count") * F.lit(buckets) > total).select("customerID")
    write_bucketed(customers, f"{name}_customers", f"{folder}/customers", buckets)
    write_bucketed(known.join(F.broadcast(large), "customerID", "left_anti"), f"{name}_facts", f"{folder}/facts", buckets)
    (known.join(F.broadcast(large), "customerID", "left_semi").write.mode("overwrite")
     .option("path", f"{folder}/large").saveAsTable(f"{name}_large"))
    return Lookup(spark, name, folder)
