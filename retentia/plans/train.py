"""Fitting, saving and loading the churn model."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from retentia.plans.features import FeatureSet, fit_features, training_columns
from retentia.sources.staging import release, stage, staging_root

ROWS_PER_TASK = 20_000
MOST_ROWS_PER_TASK = 2_000_000


@dataclass(frozen=True)
class BoosterSettings:
    rounds: int = 300
    depth: int = 5
    rate: float = 0.05
    row_sample: float = 0.8
    column_sample: float = 0.8
    bins: int = 256
    seed: int = 42


def fit_model(
    train: DataFrame, features: FeatureSet = FeatureSet(),
    settings: BoosterSettings = BoosterSettings(), partitions: int | None = None,
) -> PipelineModel:
    """Encoder, scaler and boosted trees fitted on `train`.

    Key, features and label are staged first, as encoder and scaler read them several
    times.  Only label and feature vector are staged for the boosting rounds, which read
    them from memory over and over.  Split statistics are combined per task and
    level; rows never leave their task.  Every tenth round is checkpointed, so a
    lost executor costs at most ten rounds of lineage.  `partitions` sets the
    number of tasks per round; by default one per 20,000 rows, or as many as the staged
    files have splits if those are more, and the session's parallelism at most: a round
    runs ten stages of as many tasks, so tasks beyond the cores cost more than they do.
    Only above 2,000,000 rows per task there are more.  The staged rows are deleted after
    the last round.
    """
    staging_root(train.sparkSession)
    columns = stage(training_columns(train, features), "columns")
    prepared = fit_features(columns, features)
    matrix = stage(
        prepared.transform(columns).select(
            F.col(features.label).cast("double").alias("label"), "features"
        ),
        "matrix",
    )
    dealt = matrix
    if partitions is None:
        rows, splits = matrix.count(), matrix.rdd.getNumPartitions()
        most = max(train.sparkSession.sparkContext.defaultParallelism, -(-rows // MOST_ROWS_PER_TASK))
        partitions = min(most, max(splits, rows // ROWS_PER_TASK))
        partitions = partitions if partitions != splits else None
    if partitions:
        dealt = matrix.repartition(partitions)
    booster = GBTClassifier(
        maxIter=settings.rounds, maxDepth=settings.depth, stepSize=settings.rate,
        subsamplingRate=settings.row_sample,
        featureSubsetStrategy=str(settings.column_sample), maxBins=settings.bins,
        seed=settings.seed, checkpointInterval=10, cacheNodeIds=False,
        maxMemoryInMB=1024,
    )
    release(columns)
    fitted = booster.fit(dealt)
    release(matrix)
    return PipelineModel(prepared.stages + [fitted])


def booster_of(model: PipelineModel) -> GBTClassificationModel:
    return model.stages[-1]


def feature_vectors(model: PipelineModel, df: DataFrame) -> DataFrame:
    """`df` with its encoded and scaled `features`, before the trees."""
    return PipelineModel(model.stages[:-1]).transform(df)


def predict_proba(model: PipelineModel, df: DataFrame, output: str = "score") -> DataFrame:
    """`df` with the probability of churn; one narrow stage."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(output))


def score_table(model: PipelineModel, df: DataFrame, features: FeatureSet) -> DataFrame:
    """key, label, score, pred: what the evaluation reads."""
    scored = predict_proba(model, df)
    return scored.select(
        features.key, F.col(features.label).alias("label"), "score",
        (F.col("score") >= 0.5).cast("int").alias("pred"),
    )


def holdout_loss(
    model: PipelineModel, holdout: DataFrame, features: FeatureSet
) -> DataFrame:
    """round, log_loss of the hold-out after each boosting round, in one pass."""
    rows = feature_vectors(model, holdout).select(
        F.col(features.label).cast("double").alias("label"), "features"
    )
    # Spark reports 2 log(1 + exp(-2 y F)), twice the usual log-loss.
    losses = booster_of(model).evaluateEachIteration(rows)
    return holdout.sparkSession.createDataFrame(
        [(i, loss / 2.0) for i, loss in enumerate(losses, 1)], "round int, log_loss double"
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
