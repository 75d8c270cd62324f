"""Which features drive a prediction.

Tree attribution is the published path-dependent SHAP value: a feature's average
marginal effect over all subsets of the other features, where a missing feature
follows both branches by the training rows that went each way.  Only the
features on a leaf's path matter for that leaf, at most `depth` of them, and a
row either meets a path feature's conditions or not.  So each leaf has at most
2^depth different contributions; they are computed once per model on the driver.
In the tasks every split of a tree is evaluated once per batch, into one bit per
row, and the leaves read their patterns from the bits.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from retentia.functions import shapley
from retentia.functions.shapley import LeafGroup, Splits, attribute_rows, bits, contribution_tables
from retentia.operators.sampling import fixed_size_sample
from retentia.plans.features import places
from retentia.plans.train import booster_of, feature_vectors
from retentia.sources.staging import discard, new_folder

# Ship the batch arithmetic with the job: executors need not have this package.
cloudpickle.register_pickle_by_value(shapley)

LOG_ODDS = 2.0  # Spark's margin is half the log-odds


@dataclass(frozen=True)
class Leaf:
    """One leaf: its value and, per path feature, the splits asked, those answered yes, the cover share."""

    value: float
    features: tuple
    asked: tuple
    yes: tuple
    cover: tuple


@dataclass(frozen=True)
class Tree:
    """Splits as (feature, threshold), and the leaves under them."""

    splits: list
    leaves: list


def tree_nodes(spark: SparkSession, model: PipelineModel) -> tuple[list, list]:
    """Node rows per tree, and the tree weights.

    Read from the saved form of the booster, whose size is bounded by
    rounds * 2^(depth + 1) nodes, not by the data.  The saved form is deleted again.
    """
    booster = booster_of(model)
    folder = new_folder(spark, "booster")
    booster.write().save(folder)
    rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    discard(spark, folder)
    trees = [{} for _ in booster.treeWeights]
    for row in rows:
        trees[row["treeID"]][row["id"]] = row
    return trees, list(booster.treeWeights)


def parsed_trees(trees: list, weights: list) -> list[Tree]:
    """Splits and leaves of every tree; a leaf's conditions are merged per feature."""
    return [_tree(nodes, weight) for nodes, weight in zip(trees, weights)]


def _tree(nodes, weight):
    splits, leaves, todo = [], [], [(nodes[0], {})]
    while todo:
        node, path = todo.pop()
        if node["leftChild"] < 0:
            leaves.append(_leaf(node["prediction"] * weight * LOG_ODDS, path))
            continue
        split = node["split"]
        if split["numCategories"] >= 0:
            raise ValueError("attribution needs ordered splits, found a categorical one")
        feature, number = split["featureIndex"], len(splits)
        splits.append((feature, split["leftCategoriesOrThreshold"][0]))
        asked, yes, cover = path.get(feature, ((), (), 1.0))
        left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
        to_left = left["rawCount"] / (left["rawCount"] + right["rawCount"])
        asked = (*asked, number)
        todo.append((left, {**path, feature: (asked, (*yes, number), cover * to_left)}))
        todo.append((right, {**path, feature: (asked, yes, cover * (1 - to_left))}))
    return Tree(splits, leaves)


def _leaf(value, path):
    features = tuple(sorted(path))
    asked, yes, cover = zip(*[path[f] for f in features]) if features else ((), (), ())
    return Leaf(value, features, asked, yes, cover)


def _compiled(tree: Tree) -> tuple:
    """A tree as arrays: its splits, and its leaves by the number of features on their path."""
    splits = Splits(
        np.array([f for f, _ in tree.splits], dtype=np.intp), np.array([t for _, t in tree.splits])
    )
    words = max(1, -(-len(tree.splits) // shapley.WORD))
    by_length = {}
    for leaf in tree.leaves:
        if leaf.features:
            by_length.setdefault(len(leaf.features), []).append(leaf)
    groups = [
        LeafGroup(
            np.array([leaf.features for leaf in same], dtype=np.intp),
            np.array([[bits(a, words) for a in leaf.asked] for leaf in same]),
            np.array([[bits(y, words) for y in leaf.yes] for leaf in same]),
            contribution_tables(
                np.array([leaf.value for leaf in same]), np.array([leaf.cover for leaf in same])
            ),
        )
        for same in by_length.values()
    ]
    return splits, groups


def base_value(trees: list[Tree]) -> float:
    """Expected log-odds over the training rows."""
    return float(sum(leaf.value * math.prod(leaf.cover) for tree in trees for leaf in tree.leaves))


def explainer(spark: SparkSession, model: PipelineModel) -> tuple:
    """(broadcast of the compiled trees, base value), made once per fitted or loaded model.

    It is kept with the booster, so it lives as long as the model does, and made anew
    in another Spark application.
    """
    booster, at = booster_of(model), spark.sparkContext.applicationId
    kept = getattr(booster, "explained_in", None)
    if kept is None or kept[0] != at:
        trees = parsed_trees(*tree_nodes(spark, model))
        shared = spark.sparkContext.broadcast([_compiled(t) for t in trees])
        kept = booster.explained_in = at, shared, base_value(trees)
    return kept[1:]


def tree_attribution(
    model: PipelineModel, df: DataFrame, names, key: str = "customerID"
) -> DataFrame:
    """key, base, phi (array, in feature order) for every row of `df`.

    base + sum(phi) is the log-odds of the row's probability.  Rows stay in
    their tasks; only the leaves with their tables, bounded by the model's size
    (rounds * 2^depth leaves of depth * 2^depth numbers), are shipped, once per model.
    """
    shared, base = explainer(df.sparkSession, model)
    # A feature gets what its value and its missing mark contribute.
    owner = places(model)
    to_feature = np.eye(max(owner) + 1)[owner]

    def explain(batches):
        for batch in batches:
            phi = attribute_rows(np.stack(batch["features"].to_list()), shared.value) @ to_feature if len(batch) else []
            yield pd.DataFrame({key: batch[key], "base": base, "phi": list(phi)})

    vectors = feature_vectors(model, df).select(key, vector_to_array("features").alias("features"))
    out = T.StructType([
        vectors.schema[key],
        T.StructField("base", T.DoubleType()),
        T.StructField("phi", T.ArrayType(T.DoubleType())),
    ])
    return vectors.mapInPandas(explain, out)


def gain_attribution(
    model: PipelineModel, df: DataFrame, names, key: str = "customerID"
) -> DataFrame:
    """The cheap stand-in: the model's own importances, the same for every row."""
    owner = places(model)
    gains = (booster_of(model).featureImportances.toArray() @ np.eye(max(owner) + 1)[owner]).tolist()
    return df.select(
        key, F.lit(0.0).alias("base"), F.array(*[F.lit(float(g)) for g in gains]).alias("phi")
    )


METHODS = {"shap": tree_attribution, "gain": gain_attribution}


def attribution(model, df, names, method="shap", key="customerID") -> DataFrame:
    """Attribution by an explicitly chosen method, named in `method`."""
    return METHODS[method](model, df, names, key).withColumn("method", F.lit(method))


def long_form(attributions: DataFrame, names, key: str = "customerID") -> DataFrame:
    """key, feature, phi, method: one row per customer and feature."""
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("phi"))
    return attributions.select(key, "method", F.inline(named)).select(
        key, "feature", "phi", "method"
    )


def global_importance(attributions: DataFrame, names, key: str = "customerID") -> DataFrame:
    """feature, importance, method: mean absolute contribution, largest first."""
    return (
        long_form(attributions, names, key)
        .groupBy("feature", "method")
        .agg(F.avg(F.abs("phi")).alias("importance"))
        .select("feature", "importance", "method")
        .orderBy(F.desc("importance"), "feature")
    )


def sampled_importance(
    model: PipelineModel, df: DataFrame, names, n: int = 500, method: str = "shap",
    key: str = "customerID",
) -> DataFrame:
    """Importance from a repeatable sample of n rows, for a quick look."""
    sample = fixed_size_sample(df, n, key)
    return global_importance(attribution(model, sample, names, method, key), names, key)


def write_attributions(attributions: DataFrame, names, path: str, key: str = "customerID") -> None:
    """key, feature, phi, method as Parquet."""
    long_form(attributions, names, key).write.mode("overwrite").parquet(path)


def write_importance(importance: DataFrame, path: str) -> None:
    """feature, importance as CSV with a header; one row per feature."""
    importance.select("feature", "importance").coalesce(1).write.mode("overwrite").csv(
        path, header=True
    )


def read_importance(spark, path: str) -> DataFrame:
    """Importance CSV; columns go by position, whatever the header calls them."""
    table = spark.read.csv(path, header=True)
    return table.toDF("feature", "importance").withColumn(
        "importance", F.col("importance").cast("double")
    )
