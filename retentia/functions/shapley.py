"""Arithmetic of tree attribution on a batch of rows; plain NumPy.

A leaf is reached by a row that meets the conditions of every feature on its
path.  With m path features there are 2^m patterns of met conditions, and the
attribution of a leaf depends on the pattern only.  A row's answers to all splits
of a tree are one bit each; a pattern is read from those bits, and rows with equal
answers share their attribution, so a tree is worked out once per distinct answer.
"""

import math
from dataclasses import dataclass

import numpy as np

WORD = 64  # answers per word; trees with more splits take several words


@dataclass(frozen=True)
class Splits:
    """The splits of a tree: a row answers yes when its feature is not above the threshold."""

    features: np.ndarray
    thresholds: np.ndarray

    def answers(self, columns: np.ndarray) -> np.ndarray:
        """[row, word]: bit s of a row's words is its answer to split s; NaN answers no."""
        n = len(self.features)
        words = np.zeros((columns.shape[1], max(1, -(-n // WORD))), dtype=np.uint64)
        for s in range(n):
            yes = columns[self.features[s]] <= self.thresholds[s]
            words[:, s // WORD] |= yes.astype(np.uint64) << np.uint64(s % WORD)
        return words


@dataclass(frozen=True)
class LeafGroup:
    """Leaves of a tree with equally many path features.

    A row meets the conditions of leaf l on its path feature j when its answers, cut to
    asked[l, j], are yes[l, j].  tables[l, pattern, j] is what feature
    features[l, j] then gets.
    """

    features: np.ndarray
    asked: np.ndarray
    yes: np.ndarray
    tables: np.ndarray


def bits(numbers, words: int) -> np.ndarray:
    """Words in which the given bits are set."""
    out = [0] * words
    for s in numbers:
        out[s // WORD] |= 1 << (s % WORD)
    return np.array(out, dtype=np.uint64)


def contribution_tables(values: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """[leaf, pattern, path position] -> contribution, for leaves with m path features.

    values is [leaf], cover is [leaf, position]: the share of training rows that
    meet the conditions on that feature, the stand-in for a feature that is not
    in the subset.  Bit j of a pattern is set when a row meets the conditions on
    path feature j.
    """
    n, m = cover.shape
    meets = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
    weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    tables = np.empty((n, 2**m, m))
    for i in range(m):
        # sizes[..., k]: over all subsets of k other features, the sum of products
        # of `meets` inside the subset and `cover` outside it
        sizes = np.zeros((n, 2**m, m))
        sizes[..., 0] = 1.0
        for j in range(m):
            if j != i:
                grown = sizes * cover[:, j, None, None]
                grown[..., 1:] += (sizes * meets[:, j, None])[..., :-1]
                sizes = grown
        effect = values[:, None] * (meets[:, i] - cover[:, i, None])
        tables[..., i] = effect * (sizes @ weight)
    return tables


def _distinct(words: np.ndarray):
    """Distinct rows of answers, and for every row which one it has."""
    if words.shape[1] == 1:
        kinds, which = np.unique(words[:, 0], return_inverse=True)
        return kinds[:, None], which
    kinds, which = np.unique(words, axis=0, return_inverse=True)
    return kinds, which.reshape(-1)


def _contributions(group: LeafGroup, kinds: np.ndarray, width: int) -> np.ndarray:
    """[kind, feature]: the sum over a group's leaves for every distinct row of answers."""
    leaves, m = group.features.shape
    pattern = np.zeros((len(kinds), leaves), dtype=np.intp)
    for j in range(m):
        met = ((kinds[:, None, :] & group.asked[:, j]) == group.yes[:, j]).all(axis=2)
        pattern |= met.astype(np.intp) << j
    found = group.tables[np.arange(leaves), pattern].reshape(len(kinds), leaves * m)
    to_feature = np.zeros((leaves * m, width))
    to_feature[np.arange(leaves * m), group.features.ravel()] = 1.0
    return found @ to_feature


def attribute_rows(x: np.ndarray, trees: list) -> np.ndarray:
    """Contributions [row, feature] of a batch of rows; a tree is (Splits, [LeafGroup, ...])."""
    phi = np.zeros(x.shape)
    columns = np.ascontiguousarray(x.T)
    for splits, groups in trees:
        if groups:
            kinds, which = _distinct(splits.answers(columns))
            phi += sum(_contributions(g, kinds, x.shape[1]) for g in groups)[which]
    return phi
