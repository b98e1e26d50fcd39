"""Regression trees on binned features, all trees of an ensemble grown level by level.

A level is one histogram over (tree, node, candidate feature, bin): counts, weights and weighted targets. Rows
that are only to be predicted travel along with weight zero, so no tree has to be kept. A forest averages trees
on bootstrap weights; boosting adds shrunken trees with an L2 penalty on their leaves, fitted to what is left.
"""

from __future__ import annotations

import numpy as np

BINS = 32


def binned(train: np.ndarray, rows: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Bin number of each value of `rows`: borders lie between distinct training values, at most bins - 1 of them."""
    out = np.zeros(rows.shape, np.int64)
    for j in range(train.shape[1]):
        values = np.unique(train[:, j])
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) >= bins:
            cuts = np.quantile(train[:, j], np.arange(1, bins) / bins)
            middles = np.unique(middles[np.clip(np.searchsorted(middles, cuts), 0, len(middles) - 1)])
        out[:, j] = np.searchsorted(middles, rows[:, j], side="left")
    return out


def grown(bins: np.ndarray, weight: np.ndarray, target: np.ndarray, candidates, depth: int | None, least_rows: float, least_weight: float = 0.0, penalty: float = 0.0, slots: int = BINS) -> np.ndarray:
    """Value of each row in each tree: weighted target over weight plus penalty, of the leaf it falls into.

    weight and target are (trees, rows). `candidates(trees of the nodes)` gives the features a node may split on,
    (nodes, features). A split maximises the sum of S^2 / (W + penalty) over its sides, ties to the first
    candidate and lowest bin; each side keeps least_rows rows with weight and least_weight weight.
    """
    trees, rows = weight.shape
    tree = np.repeat(np.arange(trees), rows)
    row = np.tile(np.arange(rows), trees)
    w, s = weight.ravel(), (weight * target).ravel()
    node, owner, plain = tree.copy(), np.arange(trees), bool(((w == 0) | (w == 1)).all())
    value = np.zeros(trees * rows)
    open_rows, level = np.arange(trees * rows), 0
    while len(open_rows):
        here, n_nodes = node[open_rows], len(owner)
        whole_w, whole_s = np.bincount(here, w[open_rows], n_nodes), np.bincount(here, s[open_rows], n_nodes)
        leaf = np.divide(whole_s, whole_w + penalty, out=np.zeros(n_nodes), where=whole_w + penalty > 0)
        value[open_rows] = leaf[here]
        if depth is not None and level >= depth:
            break
        features = candidates(owner)
        m = features.shape[1]
        bag = open_rows[w[open_rows] > 0]
        held = node[bag]
        key = (((held * m)[:, None] + np.arange(m)) * slots + bins[row[bag][:, None], features[held]]).ravel()
        shape = (n_nodes, m, slots)

        def summed(x: np.ndarray | None) -> np.ndarray:
            return np.cumsum(np.bincount(key, None if x is None else np.repeat(x, m), n_nodes * m * slots).reshape(shape), axis=2)

        left_n, left_s = summed(None), summed(s[bag])
        left_w = left_n if plain else summed(w[bag])
        right_n, right_w, right_s = left_n[:, :, -1:] - left_n, left_w[:, :, -1:] - left_w, left_s[:, :, -1:] - left_s
        allowed = (left_n >= max(least_rows, 1)) & (right_n >= max(least_rows, 1)) & (left_w >= least_weight) & (right_w >= least_weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_s**2 / (left_w + penalty) + right_s**2 / (right_w + penalty) - (whole_s**2 / (whole_w + penalty))[:, None, None]
        gain = np.where(allowed & np.isfinite(gain), gain, -np.inf).reshape(n_nodes, m * slots)
        best = gain.argmax(axis=1)
        split = gain[np.arange(n_nodes), best] > 1e-12 * np.maximum(np.abs(whole_s), 1e-300)
        if not split.any():
            break
        chosen, cut = features[np.arange(n_nodes), best // slots], best % slots
        stay = split[here]
        open_rows, here = open_rows[stay], here[stay]
        right = bins[row[open_rows], chosen[here]] > cut[here]
        number = np.cumsum(split) - 1
        node[open_rows] = 2 * number[here] + right
        owner = np.repeat(owner[split], 2)
        level += 1
    return value.reshape(trees, rows)


def forest(bins: np.ndarray, y: np.ndarray, train: int, seed: int, n_estimators: int, max_depth: int | None, min_samples_leaf: int, max_features: str | float) -> np.ndarray:
    """Predictions of all rows; the first `train` rows have a target, the rest are only predicted."""
    rng = np.random.default_rng(seed)
    n_features = bins.shape[1]
    m = max(1, int(np.sqrt(n_features)) if max_features == "sqrt" else int(max_features * n_features))
    weight = np.zeros((n_estimators, len(bins)))
    for t in range(n_estimators):
        weight[t, :train] = np.bincount(rng.integers(0, train, train), minlength=train)
    target = np.zeros((1, len(bins)))
    target[0, :train] = y
    pick = lambda owner: np.argsort(rng.random((len(owner), n_features)), axis=1)[:, :m]
    return grown(bins, weight, target, pick, max_depth, min_samples_leaf).mean(axis=0)


def boosted(bins: np.ndarray, y: np.ndarray, train: int, seed: int, n_estimators: int, max_depth: int, learning_rate: float, subsample: float, colsample_bytree: float, reg_lambda: float) -> np.ndarray:
    """Predictions of all rows after the last round; squared loss, started at the mean target."""
    rng = np.random.default_rng(seed)
    n_features = bins.shape[1]
    m = max(1, int(colsample_bytree * n_features))
    out = np.full(len(bins), y.mean())
    for _ in range(n_estimators):
        weight = np.zeros((1, len(bins)))
        weight[0, :train] = rng.random(train) < subsample
        left = np.zeros((1, len(bins)))
        left[0, :train] = y - out[:train]
        columns = np.sort(rng.permutation(n_features)[:m])
        out += learning_rate * grown(bins, weight, left, lambda owner: np.tile(columns, (len(owner), 1)), max_depth, 1, 1.0, reg_lambda)[0]
    return out
