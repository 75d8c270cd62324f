"""Running totals over one global order without a single-task window."""

from pyspark.sql import DataFrame, Window, functions as F

from retentia.sources.staging import stage


def running_counts(scores: DataFrame, cuts: int | None = None) -> DataFrame:
    """Per distinct score: pos, neg, and their totals from the top score down.

    `next_pos` and `next_neg` are the counts of the next lower score.

    `scores` has `score` and a 0/1 `label`.  Equal scores are merged first, with
    map-side combining, so a score shared by many rows is one row here, and staged,
    as the steps below read them three times.  The
    distinct scores are cut into `cuts` ranges, by default one per shuffle partition,
    at their quantiles; each range is summed
    on its own and shifted by the totals of the ranges above it, of which there
    are at most cuts + 1 rows (safe to broadcast and to order in one task).
    Where exactly the cuts fall has no effect on the result.
    """
    cuts = cuts or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_score = stage(
        scores.where("score is not null and label is not null").groupBy("score").agg(
            F.count_if(F.col("label") == 1).alias("pos"),
            F.count_if(F.col("label") == 0).alias("neg"),
        ),
        "per-score",
    )
    points = [i / cuts for i in range(1, cuts)]
    summary = per_score.agg(
        F.struct(
            F.percentile_approx("score", points, 1000).alias("edges"),
            F.sum("pos").alias("all_pos"),
            F.sum("neg").alias("all_neg"),
        )
    ).scalar()
    ranged = per_score.withColumn("_s", summary).select(
        "score", "pos", "neg",
        F.col("_s.all_pos").alias("all_pos"), F.col("_s.all_neg").alias("all_neg"),
        F.size(F.filter("_s.edges", lambda edge: edge < F.col("score"))).alias("range"),
    )

    down = Window.orderBy(F.desc("range"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        ranged.groupBy("range")
        .agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"),
             F.max_by("pos", "score").alias("top_pos"), F.max_by("neg", "score").alias("top_neg"))
        .select(
            "range",
            F.coalesce(F.sum("p").over(above), F.lit(0)).alias("pos_above"),
            F.coalesce(F.sum("n").over(above), F.lit(0)).alias("neg_above"),
            F.lead("top_pos").over(down).alias("pos_below"),
            F.lead("top_neg").over(down).alias("neg_below"),
        )
    )
    inside = Window.partitionBy("range").orderBy(F.desc("score"))
    return ranged.join(F.broadcast(shift), "range").select(
        "score", "pos", "neg", "all_pos", "all_neg",
        (F.col("pos_above") + F.sum("pos").over(inside)).alias("cum_pos"),
        (F.col("neg_above") + F.sum("neg").over(inside)).alias("cum_neg"),
        F.coalesce(F.lead("pos").over(inside), F.col("pos_below")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inside), F.col("neg_below")).alias("next_neg"),
    )
