"""Encoding and scaling of model inputs."""

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct, Imputer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from retentia import schema as S

CODE = "_code"
MISSING = "_missing"


@dataclass(frozen=True)
class FeatureSet:
    """Which columns the model reads, in vector order: numbers, then categories."""

    numbers: tuple = tuple(S.NUMERIC_FEATURES)
    categories: tuple = tuple(S.CATEGORY_FEATURES)
    label: str = "Churn"
    key: str = "customerID"
    names: tuple = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "names", tuple(self.numbers) + tuple(self.categories))


def training_columns(df: DataFrame, features: FeatureSet) -> DataFrame:
    """Key, features and label in their fixed order; nothing else is read."""
    return df.select(features.key, *features.names, features.label)


def _text_stage(categories) -> SQLTransformer:
    """Nulls become a class of their own, as text 'None'."""
    texts = ", ".join(f"coalesce(cast(`{c}` AS string), 'None') AS `{c}{CODE}_text`" for c in categories)
    return SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__")


def _known_stage(categories, labels) -> SQLTransformer:
    """Classes not seen in fitting get code 0.

    The indexer numbers them one past the last class.  The plain expression also
    drops the column's nominal metadata, so trees order codes as numbers.
    """
    codes = ", ".join(
        f"CASE WHEN `{c}{CODE}_raw` >= {len(seen)} THEN 0.0D ELSE `{c}{CODE}_raw` END AS `{c}{CODE}`"
        for c, seen in zip(categories, labels)
    )
    return SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__")


def fit_encoder(df: DataFrame, categories, strict: bool = False) -> PipelineModel:
    """Codes 0..k-1 by sorted class per column, as `<column>_code`.

    Values not seen in fitting become 0, or fail the job when `strict`.
    """
    categories = list(categories)
    text = _text_stage(categories)
    indexer = StringIndexer(
        inputCols=[f"{c}{CODE}_text" for c in categories],
        outputCols=[f"{c}{CODE}_raw" for c in categories],
        stringOrderType="alphabetAsc", handleInvalid="error" if strict else "keep",
    ).fit(text.transform(df))
    return PipelineModel([text, indexer, _known_stage(categories, indexer.labelsArray)])


def encode(df: DataFrame, encoder: PipelineModel, categories) -> DataFrame:
    """`df` with the categories replaced by their integer codes."""
    coded = encoder.transform(df)
    return coded.select(
        *[F.col(f"{c}{CODE}").cast("int").alias(c) if c in categories else c for c in df.columns]
    )


def missing_numbers(df: DataFrame, columns) -> list:
    """The columns in which `df` holds a null or NaN."""
    if not columns:
        return []
    value = {c: F.col(f"`{c}`").cast("double") for c in columns}
    found = df.agg(*[F.bool_or(v.isNull() | F.isnan(v)).alias(c) for c, v in value.items()]).first()
    return [c for c in columns if found[c]]


def fit_scaler(df: DataFrame, columns, marked=()) -> PipelineModel:
    """(x - mean) / population deviation of `columns`, as vector `features`.

    Spark divides by the sample deviation; the last stage corrects that.  A
    constant column gives 0.  Nulls and NaN take the mean of the fitted rows, so
    they become 0 and neither fail the fit nor a later batch or stream.  Each column
    in `marked` has a further place at the end, whether its value is missing, by which
    trees can send missing values to the side that suits the label.
    """
    numbers = [f"CAST(`{c}` AS double) AS `{c}_number`" for c in columns]
    numbers += [
        f"CASE WHEN `{c}` IS NULL OR isnan(CAST(`{c}` AS double)) THEN 1.0D ELSE 0.0D END AS `{c}{MISSING}`"
        for c in marked
    ]
    inputs = [f"{c}_filled" for c in columns] + [f"{c}{MISSING}" for c in marked]
    steps = Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {', '.join(numbers)} FROM __THIS__"),
        Imputer(strategy="mean", inputCols=[f"{c}_number" for c in columns],
                outputCols=[f"{c}_filled" for c in columns]),
        VectorAssembler(inputCols=inputs, outputCol="_inputs"),
        StandardScaler(inputCol="_inputs", outputCol="_scaled", withMean=True, withStd=True),
    ]).fit(df)
    n = df.count()
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    population = ElementwiseProduct(
        inputCol="_scaled", outputCol="features",
        scalingVec=Vectors.dense([factor] * len(inputs)),
    )
    return PipelineModel(steps.stages + [population])


def fit_features(df: DataFrame, features: FeatureSet) -> PipelineModel:
    """Encoder and scaler as one fitted pipeline; fit it on training rows only.

    Numbers that are missing in some training row get a place of their own for that.
    """
    marked = missing_numbers(df, features.numbers)
    stages = []
    if features.categories:
        encoder = fit_encoder(df, features.categories)
        stages += encoder.stages
        df = encoder.transform(df)
    columns = list(features.numbers) + [f"{c}{CODE}" for c in features.categories]
    return PipelineModel(stages + fit_scaler(df, columns, marked).stages)


def places(model: PipelineModel) -> list:
    """For every place of a fitted pipeline's vector, the number of the feature it belongs to.

    A missing mark belongs to the number it marks.
    """
    inputs = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    values = [c.removesuffix("_filled") for c in inputs if c.endswith("_filled")]
    return [
        values.index(c.removesuffix("_filled") if c.endswith("_filled") else c.removesuffix(MISSING)) for c in inputs
    ]
