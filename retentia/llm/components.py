"""Connected components of a graph given as edges."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from retentia.sources.staging import release, stage


def star_edges(left: np.ndarray, right: np.ndarray):
    """Edges that join each node of a local graph to the smallest node it reaches.

    At most one edge per node, however many edges came in.
    """
    nodes, at = np.unique(np.r_[left, right], return_inverse=True)
    a, b = at[:len(left)], at[len(left):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _state(edges: DataFrame):
    """Number of edges and an order-free sum over them: equal for equal edge sets."""
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (two whole-number columns u, v).

    The component is its smallest node.  Large-star and small-star steps alternate
    until nothing changes; that takes rounds in the order of the logarithm of the
    longest path.  A step keeps at most as many edges as there were.  Minima are
    combined before the shuffle; joins on a hub with very many edges are left to
    adaptive skew handling, as only its side of the join is large.  Every round is
    staged, and the one before deleted; the result can be released too.  Null ends and loops are ignored.
    """
    current = stage(
        edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "edges",
    )
    state = _state(current)
    while True:
        # Large star: larger neighbours of a node move to its smallest neighbour.
        least = current.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        moved = current.join(least, current["u"] == least["n"], "left").select(
            F.coalesce("m", "u").alias("u"), "v"
        )
        # A node with smaller neighbours stays linked to the smallest of them.
        large = stage(
            moved.unionByName(least.select(F.col("m").alias("u"), F.col("n").alias("v"))).distinct(), "large"
        )
        # Small star: the smaller neighbours of a node move to the smallest of them.
        least = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        small = large.join(least, large["v"] == least["n"]).select("m", "u", "v")
        last, current = current, stage(
            small.select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
            .unionByName(small.select(F.col("m").alias("u"), "v")).distinct(),
            "edges",
        )
        release(last)
        release(large)
        before, state = state, _state(current)
        if state == before:
            break
    out = current.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
    out.staged_in = current.staged_in
    return out
