"""Scoring as a stream: stateless, so no watermark and no state store."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from retentia import schema as S
from retentia.plans.score import score_customers
from retentia.sources.requests import score_requests, unreadable_fields

ROWS_PER_TASK = 5_000


def record_stream(spark: SparkSession, folder: str, schema: T.StructType, files=None) -> DataFrame:
    """Parquet records as they arrive in `folder`; `files` bounds one batch."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def score_stream(
    model: PipelineModel, records: DataFrame, out: str, checkpoint: str,
    keep=("customerID",), available_now: bool = True, interval: str = "10 seconds",
) -> StreamingQuery:
    """Append predictions to Parquet, each record once.

    `checkpoint` must be on shared storage: it is where a restarted query finds
    how far it got.
    """
    writer = (
        score_customers(model, records, keep)
        .writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def score_requests_stream(
    model: PipelineModel, records: DataFrame, out: str, rejected: str, checkpoint: str,
    keep=("customerID",), defaults: dict = S.REQUEST_DEFAULTS, total_from_tenure: bool = True,
    available_now: bool = True, interval: str = "10 seconds",
) -> StreamingQuery:
    """Score the requests that can be read to `out`; the others go to `rejected` as they came.

    A rejected record has its own columns and `unreadable`, the features whose values
    their types cannot hold.  Both sinks have a folder per micro-batch, named by its
    number and replaced as a whole: a batch that is run again after a failure, between the
    two writes or after both, leaves every record once.  `checkpoint` must be on shared
    storage.  A batch of few files is dealt out for scoring, one task per 5,000 rows and the
    session's parallelism at most.
    """
    fields = records.columns

    def both(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("unreadable", unreadable_fields(batch, defaults)).persist()
        good = marked.where(F.size("unreadable") == 0).select(*fields)
        tasks = min(batch.sparkSession.sparkContext.defaultParallelism, marked.count() // ROWS_PER_TASK)
        if tasks > marked.rdd.getNumPartitions():
            good = good.repartition(tasks)
        scored = score_customers(model, score_requests(good, total_from_tenure, defaults), keep)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad = marked.where(F.size("unreadable") > 0)
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        marked.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        records.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
