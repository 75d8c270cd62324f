"""Customer CSV in, tables out and back in."""

import json
import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from retentia import schema as S
from retentia.operators.clean import clean_customers
from retentia.plans.reports import segment_summary
from retentia.sources.staging import discard, list_names, read_text, release, stage, swap_text

MANIFEST = "CURRENT.json"
EMPTY = "_contract_is_empty"


def csv_scan(spark: SparkSession, path: str, schema=S.RAW_CUSTOMERS) -> DataFrame:
    """Customer CSV with a header, TotalCharges and Churn left as text.

    Columns are matched by name, as files may hold more of them and in another
    order than `schema`; a missing path raises PATH_NOT_FOUND right here, before any
    job.  Columns beyond `schema` are kept as text.  All files of one path must have
    the same header: reading one that differs fails, as its values would land in the
    wrong columns; scan it by itself and union by name.
    """
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    known = {f.name: f.dataType for f in schema.fields}
    return raw.select(
        *[F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`")
          for c in raw.columns]
    )


def derive_tables(raw: DataFrame, transactions: DataFrame, tickets: DataFrame) -> dict:
    """The four tables from raw customers and the two fact sources, not stored."""
    customers = clean_customers(raw)
    return {
        "customers": customers,
        "transactions": transactions,
        "support_tickets": tickets,
        "segment_summary": segment_summary(customers),
    }


def build_tables(
    raw: DataFrame, transactions: DataFrame, tickets: DataFrame, path: str
) -> dict:
    """Clean, store and read back the four tables.

    The segment summary is taken from the stored customers, so the raw records
    are read once.  All four take the place of earlier ones at the same moment.
    """
    spark = raw.sparkSession
    tables = {
        "customers": clean_customers(raw), "transactions": transactions,
        "support_tickets": tickets,
    }
    schemas = {n: df.schema for n, df in tables.items()}
    places = _write_set(tables, path)
    stored = _read_places(spark, {n: f"{path}/{p}" for n, p in places.items()}, schemas)
    summary = segment_summary(stored["customers"])
    places |= _write_set({"segment_summary": summary}, path)
    publish(spark, path, places)
    return read_tables(spark, path, places, schemas | {"segment_summary": summary.schema})


def write_tables(tables: dict, path: str) -> None:
    """Replace the given tables under `path`, all at the same moment.

    They are written to folders of their own first; then a manifest that names the
    current folder of every table is swapped in.  A reader sees all tables of
    before or all of after, and one that began before goes on reading its files.  Tables
    that are not given stay as they are.  Two writers at once need a lock of
    their own: the last manifest counts.  `expire` deletes folders no longer named.

    customers: one directory per Contract, so a filter on it prunes files, and
    ordered by Churn inside, so row groups can be skipped.  The rebalance hint
    lets adaptive execution split a large Contract over several files.  Directory
    names have no empty value, so a column in the files marks it.
    Fact tables: range-clustered by customerID, so a customer's rows sit in few
    row groups and per-customer aggregation is nearly done before the shuffle.
    """
    spark = next(iter(tables.values())).sparkSession
    publish(spark, path, current_places(spark, path) | _write_set(tables, path))


def _write_set(tables: dict, path: str) -> dict:
    """Write tables to a new folder under `path`; table -> its place below `path`."""
    version = f"sets/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        if name == "customers":
            writer = (
                df.withColumn(EMPTY, F.coalesce(F.col("Contract") == "", F.lit(False)))
                .hint("rebalance", "Contract").sortWithinPartitions("Contract", "Churn")
                .write.partitionBy("Contract")
            )
        elif name in ("transactions", "support_tickets"):
            # Ranges are found on a sample: staged, so that what derives the facts runs once.
            facts = stage(df, name)
            _clustered(facts).write.parquet(f"{path}/{version}/{name}")
            release(facts)
            continue
        else:
            writer = df.write
        writer.parquet(f"{path}/{version}/{name}")
    return {name: f"{version}/{name}" for name in tables}


def publish(spark: SparkSession, path: str, places: dict) -> None:
    """Swap in the manifest: one file, replaced by a rename."""
    swap_text(spark, f"{path}/{MANIFEST}", json.dumps(places, sort_keys=True))


def current_places(spark: SparkSession, path: str) -> dict:
    """table -> its current place below `path`; nothing where no manifest is yet."""
    text = read_text(spark, f"{path}/{MANIFEST}")
    return json.loads(text) if text else {}


def expire(spark: SparkSession, path: str, keep: int = 1) -> list:
    """Delete the folders that no table is read from any more, but for the `keep` newest of them.

    Readers may still be using the newest ones.  Returns what was deleted.
    """
    used = {place.rsplit("/", 1)[0] for place in current_places(spark, path).values()}
    old = sorted(f"sets/{name}" for name in list_names(spark, f"{path}/sets"))
    gone = [v for v in old if v not in used]
    gone = gone[:len(gone) - keep] if keep else gone
    for version in gone:
        discard(spark, f"{path}/{version}")
    return gone


def _clustered(df: DataFrame) -> DataFrame:
    # All columns take part in the range, so that a customer with very many rows
    # is cut into several ranges instead of landing in one.
    keys = ["customerID"] + [c for c in df.columns if c != "customerID"]
    return df.repartitionByRange(*keys).sortWithinPartitions("customerID")


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> None:
    """A table bucketed by customerID, one file per bucket, for repeated joins on it.

    Only for tables whose customers are of similar size: a bucket is read by one
    task.  `lookup.write_lookup` takes care of larger ones.
    """
    (df.repartition(buckets, "customerID").write.mode("overwrite").option("path", path)
       .bucketBy(buckets, "customerID").sortBy("customerID").saveAsTable(table))


def read_tables(spark: SparkSession, path: str, names=S.TABLES, schemas=None) -> dict:
    """Stored tables of the current manifest; a known schema saves looking it up in the files.

    Without one the columns come from the files, but the contract, which stands in
    the directory names, is text whatever it looks like.  Contracts come back as
    they were, also empty ones.
    """
    places = current_places(spark, path)
    return _read_places(spark, {n: f"{path}/{places[n]}" for n in names}, schemas)


def _read_places(spark, places, schemas):
    found = {}
    for name, place in places.items():
        schema = (schemas or {}).get(name)
        if schema is None:
            fields = spark.read.parquet(place).schema.fields
            schema = T.StructType([
                T.StructField("Contract", T.StringType()) if f.name == "Contract" else f
                for f in fields if f.name != EMPTY
            ])
        if name != "customers":
            found[name] = spark.read.schema(schema).parquet(place)
            continue
        marked = T.StructType([*schema.fields, T.StructField(EMPTY, T.BooleanType())])
        rows = spark.read.schema(marked).parquet(place)
        # Both empty and missing contracts stand in the directory without a name.
        empty = F.expr(f"if({EMPTY}, '', CAST(NULL AS string))").alias("Contract")
        found[name] = rows.where("Contract IS NOT NULL").select(*schema.names).unionByName(
            rows.where("Contract IS NULL").select(*[empty if c == "Contract" else c for c in schema.names])
        )
    return found


def register_views(tables: dict) -> None:
    """Make the tables known to SQL under their names, replacing earlier ones."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def cached(df: DataFrame) -> DataFrame:
    """Keep a frame that several reports read; spills to disk, survives loss."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def row_count_report(tables: dict) -> DataFrame:
    """table_name, n_rows: one row per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    report = counts[0]
    for one in counts[1:]:
        report = report.unionByName(one)
    return report


def schema_listing(spark: SparkSession, tables: dict) -> DataFrame:
    """table_name, position, column_name, column_type for every table."""
    rows = [
        (name, i, field.name, field.dataType.simpleString())
        for name, df in tables.items()
        for i, field in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, column_type string"
    )
