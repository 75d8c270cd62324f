"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession


def session(app="retentia", master=None, shuffle_partitions=None, **conf):
    """Build a session with adaptive execution on.

    `shuffle_partitions` is the starting number: on a cluster give several per
    core and let adaptive execution merge the small ones; on a laptop one per
    core is enough.  Master, memory and `spark.checkpoint.dir` are left to
    spark-submit unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site lookup for every column costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
