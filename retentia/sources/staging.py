"""Intermediate results written once and read many times.

A staged frame is a Parquet table in the cluster's shared checkpoint folder: it
cuts the lineage, outlives lost executors and is read column by column.
"""

import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=None)
def _local_root():
    return tempfile.mkdtemp(prefix="retentia-")


def staging_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, also set for RDD checkpoints.

    Where the setting is missing a temporary folder is used in local mode only;
    on a cluster that folder would not be shared, so it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage", *by: str) -> DataFrame:
    """Write `df`, a folder for each value of the columns `by`, and return a frame that reads it back."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.partitionBy(*by).parquet(folder)
    staged = spark.read.schema(df.schema).parquet(folder)
    staged.staged_in = folder
    return staged


def _path(spark, name):
    """A path and the file system it is on, whichever that is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder; one that is gone already is no error."""
    path, system = _path(spark, folder)
    system.delete(path, True)


def list_names(spark: SparkSession, folder: str) -> list:
    """Names in a folder; none where it does not exist."""
    path, system = _path(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def file_states(spark: SparkSession, name: str) -> list:
    """(path, size, change time) of every file under a folder, or of one file."""
    path, system = _path(spark, name)
    files, found = system.listFiles(path, True), []
    while files.hasNext():
        state = files.next()
        found.append((state.getPath().toString(), state.getLen(), state.getModificationTime()))
    return found


def read_text(spark: SparkSession, name: str) -> str | None:
    """A small text file, or None where it does not exist."""
    path, system = _path(spark, name)
    return spark.read.text(name, wholetext=True).first()[0] if system.exists(path) else None


def swap_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a small text file and put it in the place of `name` by a rename."""
    jvm = spark.sparkContext._jvm
    path, system = _path(spark, name)
    fresh, _ = _path(spark, f"{name}.{uuid.uuid4().hex}")
    out = system.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    kinds[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files.rename(fresh, path, kinds)


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that `stage` returned; nothing may read it any more."""
    discard(df.sparkSession, df.staged_in)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It does so when their frames are garbage on the driver, whose large heap may not be
    collected for long; between the phases of a large job that would keep the files
    of all phases on the executors' disks.  Spark holds on to the last job it ran, hence
    the small one.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
