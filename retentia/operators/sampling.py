"""Previews, repeatable samples and top-k."""

from pyspark.sql import DataFrame, functions as F


def hash_key(seed, key):
    """Pseudo-random, repeatable sort key: hex text, uniform over distinct keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def preview(df: DataFrame, n: int = 200, key: str = "customerID") -> DataFrame:
    """The first n rows in key order."""
    return df.orderBy(key).limit(n)


def fixed_size_sample(df: DataFrame, n: int = 1500, key: str = "customerID", seed: int = 42):
    """n rows without replacement, the same ones on every run and cluster.

    Each task keeps its own n smallest hashes, so no full sort takes place.
    With fewer than n rows all are returned.  The rows do not depend on how the
    input is stored, as 'the first n' would.
    """
    return df.orderBy(hash_key(seed, key), key).limit(n)


def fraction_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """About `fraction` of the rows, when the exact number does not matter."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """The n features with the largest importance, ties by name."""
    if n < 0:
        raise ValueError("n must not be negative")
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
